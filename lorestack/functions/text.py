"""Column functions on text: splitting, chunking, budgets, markers and labels. All run inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"(?U)\s+"
#: The markup marker of an image standing in plain text.
IMAGE_MARKER = r"\[\[image: \d{4,6}\.[a-z0-9]{1,5}\]\]"
#: Where sentences are cut: two characters that stand next to each other in no text.
_CUT = "\x00\ue000"
IMAGE_NAME = r"^\d{4,6}\.[a-z0-9]{1,5}$"


def trim_unicode(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def words(text: Column) -> Column:
    """The words between Unicode white space; null for null."""
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def repair_hyphens(text: Column) -> Column:
    """Join a word broken by a hyphen and one space or newline before a lower-case letter."""
    return F.regexp_replace(text, r"(?<=\p{IsAlphabetic})-[ \n](?=[\p{IsAlphabetic}&&\p{IsLowercase}])", "")


def window_words(max_tokens: int, overlap_tokens: int, words_per_token: float = 0.75) -> tuple[int, int]:
    """Words in a chunk and words from one chunk's start to the next: at least one word of overlap, when there is room."""
    window = max(int(max_tokens * words_per_token), 1)
    overlap = min(max(int(overlap_tokens * words_per_token), 1), window - 1)
    return window, window - overlap


def chunks(text: Column, max_tokens: int = 512, overlap_tokens: int = 64, words_per_token: float = 0.75) -> Column:
    """Array of overlapping chunks; the last ends at the last word. A text without words has none.

    The words are bound once, by an outer transform over an array of one, and not split again for every chunk.
    """
    window, step = window_words(max_tokens, overlap_tokens, words_per_token)

    def made(w: Column) -> Column:
        last = F.greatest(F.lit(0), F.ceil((F.size(w) - window) / step)).cast("int")
        each = F.transform(F.sequence(F.lit(0), last), lambda i: F.concat_ws(" ", F.slice(w, 1 + i * step, window)))
        return F.when(F.size(w) > 0, each).otherwise(F.array().cast("array<string>"))

    return F.get(F.transform(F.array(F.coalesce(words(text), F.array().cast("array<string>"))), made), 0)


def paragraphs(text: Column) -> Column:
    """Parts between runs of ASCII white space with two newlines or more, trimmed, without empty ones."""
    parts = F.split(text, r"[ \t\r\f]*\n[ \t\r\f]*\n[ \t\r\n\f]*")
    return F.filter(F.transform(parts, trim_unicode), lambda p: p != "")


def sentences(text: Column) -> Column:
    """Parts that end with . ! ? or an ellipsis, closing marks included, before white space; no empty ones.

    A mark that follows the white space keeps the sentence going. Any number of closing marks count.
    """
    parts = F.split(F.regexp_replace(text, r"(?U)([.!?…][\"')\]»”’]*+)\s++(?![.!?…])", f"$1{_CUT}"), _CUT)
    return F.filter(F.transform(parts, trim_unicode), lambda s: s != "")


def truncate_utf8(text: Column, limit: Column | int) -> Column:
    """The longest prefix of at most ``limit`` bytes that ends between characters."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    data = F.encode(text, "utf-8")
    cuts = [F.substring(data, F.lit(1), F.greatest(limit - k, F.lit(0))) for k in range(4)]
    cut = F.coalesce(*(F.when(F.is_valid_utf8(c.cast("string")), c.cast("string")) for c in cuts))
    return F.when(F.octet_length(text) <= limit, text).otherwise(cut)


def namespace_of(kind: Column, chat_id: Column) -> Column:
    """global, chat:<id> or memory:<id>."""
    return F.when(kind == "global", F.lit("global")).otherwise(F.concat(kind, F.lit(":"), chat_id.cast("string")))


def answer_budget(context: Column, cap: int = 2048, least: int = 256) -> Column:
    """Tokens kept for the answer: half the window within bounds; the cap where the window is unknown."""
    return F.when(context.isNull(), F.lit(cap)).otherwise(F.least(F.lit(cap), F.greatest(F.floor(context / 2).cast("int"), F.lit(least))))


def prompt_budget(context: Column, default: int = 4096, chars_per_token: int = 4) -> Column:
    """Bytes left for the prompt, never below 0."""
    return F.greatest((F.coalesce(context, F.lit(default)) - answer_budget(context)) * chars_per_token, F.lit(0))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: characters beyond U+FFFF count twice."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def escape_text(text: Column) -> Column:
    """& < > as entities."""
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def image_marker(number: Column, extension: Column) -> Column:
    """[[image: NNNN.ext]] with at least four digits."""
    digits = F.when(number > 9999, number.cast("string")).otherwise(F.lpad(number.cast("string"), 4, "0"))
    return F.concat(F.lit("[[image: "), digits, F.lit("."), extension, F.lit("]]"))


def is_image_marker(text: Column) -> Column:
    """A paragraph that is one marker and nothing else."""
    return trim_unicode(text).rlike(f"^{IMAGE_MARKER}$")


def without_image_markers(text: Column) -> Column:
    """Inline markers out, white space collapsed."""
    return trim_unicode(F.regexp_replace(F.regexp_replace(text, IMAGE_MARKER, ""), SPACES, " "))


def is_speakable(text: Column) -> Column:
    """Has a letter or a digit, and is not an image marker."""
    return trim_unicode(text).rlike(r"[\p{IsAlphabetic}\p{N}]") & ~is_image_marker(text)


def should_record_turn(memory_on: Column, failed: Column, cancelled: Column, answer: Column) -> Column:
    """Whether a turn goes to the memory: on, finished well, and with an answer that isn't blank."""
    return memory_on & ~failed & ~cancelled & (F.coalesce(trim_unicode(answer), F.lit("")) != "")


def attachment_route(text: Column, failed: Column, whole_limit: int = 8000) -> Column:
    """error, injected_whole (up to ``whole_limit`` bytes) or index."""
    return F.when(failed | text.isNull(), "error").when(F.octet_length(text) <= whole_limit, "injected_whole").otherwise("index")


#: Bytes per weight of each quantisation.
WEIGHT_BYTES = {"Q4": 0.5, "Q5": 0.625, "Q8": 1.0, "F16": 2.0}


def ram_estimate(parameters: Column, quantisation: Column, overhead: float = 1.2) -> Column:
    """Bytes that a model needs; null for an unknown quantisation."""
    per_weight = F.create_map(*(F.lit(x) for pair in WEIGHT_BYTES.items() for x in pair))
    return parameters * F.element_at(per_weight, quantisation) * overhead


def fits_ram(needed: Column, ram: Column) -> Column:
    """True within the memory, or where the memory is unknown."""
    return (ram <= 0) | ram.isNull() | (needed <= ram)


def turn_text(question: Column, answer: Column, asks: str = "Usuário", answers: str = "Assistente") -> Column:
    """A turn as one text."""
    return F.concat(F.lit(f"{asks}: "), question, F.lit(f"\n{answers}: "), answer)


def source_block(label: Column, text: Column, word: str = "fonte") -> Column:
    """A cited text."""
    return F.concat(F.lit(f"[{word}: "), label, F.lit("]\n"), text)


def joined_sections(*sections: Column) -> Column:
    """Sections with a rule between them; null and empty ones are left out."""
    return F.array_join(F.filter(F.array(*sections), lambda s: s.isNotNull() & (s != "")), "\n\n---\n\n")


def squared_l2(x: Column, y: Column) -> Column:
    """Sum of squared differences in double precision; NaN where there is no score."""
    pairs = F.zip_with(x.cast("array<double>"), y.cast("array<double>"), lambda a, b: (a - b) * (a - b))
    total = F.aggregate(pairs, F.lit(0.0), lambda acc, v: acc + v)
    return F.when(F.size(x) == F.size(y), total).otherwise(F.lit(float("nan")))


def cosine(x: Column, y: Column) -> Column:
    """Cosine similarity in double precision; null for a zero vector."""
    dot = lambda a, b: F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(norm > 0, dot(x, y) / norm)
