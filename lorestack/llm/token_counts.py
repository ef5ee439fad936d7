"""Token counts by a two-tier lookup on the map side; only the counts that choose the frequent runs are shuffled.

A tokenizer that drops white space gives every run between white space the same tokens in any text. The first tier is a
broadcast table of the lengths of frequent runs, at most ``frequent`` entries of at most ``MOST_BYTES`` bytes each (a few
MB, whatever the input's size). The second is a cache in each worker: a miss is encoded once, with the other misses of
its block, and kept from task to task within a bound of bytes.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorestack.llm.pieces import Cache, blocks, only

#: Longer runs stay out of the broadcast table.
MOST_BYTES = 48
_WORKER: dict = {}
_SCHEMA = "doc_id long, n_bytes long, n_tokens long"


def _encoder(path: str):
    """token counts of a list of runs, by the library that reads the file."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in processor.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(x.ids) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class Counts:
    """One worker's encoder of a file and the lengths of the runs it has met."""

    built = 0

    def __init__(self, path: str, cache_bytes: int):
        Counts.built += 1
        self.encode = _encoder(path)
        self.lengths = Cache(lambda run: self.encode([run.decode("utf-8", "replace")])[0], cache_bytes)

    def learn(self, runs: Iterable[bytes]) -> dict[bytes, int]:
        """Lengths of runs that the cache lacks, encoded in one batch; the cache takes them in."""
        missing = [k for k in runs if k not in self.lengths and k not in self.lengths.old]
        new = dict(zip(missing, self.encode([k.decode("utf-8", "replace") for k in missing]), strict=True))
        self.lengths.put(new)
        return new


def counts(path: str, cache_bytes: int) -> Counts:
    """This worker's encoder of a file, built once and kept from task to task."""
    if path not in _WORKER:
        _WORKER[path] = Counts(path, cache_bytes)
    only(_WORKER[path].lengths)
    return _WORKER[path]


def frequent_runs(docs: DataFrame, text_col: str, frequent: int, one_in: int) -> list[bytes]:
    """The most frequent runs of one row in ``one_in``, by a hash of the row; only speed depends on which they are.

    Each task counts the runs of its rows and hands on its ``frequent`` commonest; Spark adds these up, and of the sums
    the ``frequent`` highest are gathered.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                seen.update(k for k in (text or b"").split() if len(k) <= MOST_BYTES)
            if len(seen) > 20 * frequent:  # rare ones give way, so that a task's memory doesn't grow with its rows
                seen = Counter(dict(seen.most_common(10 * frequent)))
        top = seen.most_common(frequent)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in top], pa.binary()), pa.array([n for _, n in top], pa.int64())], names=["run", "n"])

    text = F.col(text_col).cast("string")
    some = docs.select(text.alias("text"), F.xxhash64(*docs.columns).alias("h") if one_in > 1 else F.lit(0).alias("h")).filter(F.pmod("h", F.lit(one_in)) == 0).select("text")
    summed = some.mapInArrow(count, "run binary, n long").groupBy("run").agg(F.sum("n").alias("n")).filter("n > 1")
    return [bytes(r.run) for r in summed.orderBy(F.desc("n"), "run").limit(frequent).collect()]


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", frequent: int = 50_000, one_in: int = 32, cache_bytes: int = 80 << 20, block_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens of every row, without begin, end or added special tokens.

    For tokenizers that drop white space (``.json`` of the word BPE); a tokenizer that keeps it (``.model``) is given
    whole texts. A null text counts as empty: 0 bytes, 0 tokens. Null identifiers, repeated rows and other columns of any
    name are kept as they come. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    by_run = not tokenizer_path.endswith(".model")
    runs = frequent_runs(docs.select(id_col, text_col), text_col, frequent, one_in) if by_run else []
    lengths = _encoder(tokenizer_path)([r.decode("utf-8", "replace") for r in runs]) if runs else []
    tier = {k: n for k, n in zip(runs, lengths, strict=True) if n}  # a run without tokens is left to the cache
    shared = spark.sparkContext.broadcast(tier)  # ``frequent`` entries of ``MOST_BYTES`` at most

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counts(tokenizer_path, cache_bytes)
        table = shared.value
        for block in blocks(batches, "text", block_bytes):
            texts = [x or b"" for x in block.column("text").cast(pa.binary()).to_pylist()]
            if by_run:
                cut = [x.split() for x in texts]
                new = own.learn(k for k in set().union(*cut) if k not in table)
                first, second = table.get, own.lengths.__getitem__
                n_tokens = [sum(first(k) or new.get(k) or second(k) for k in words) for words in cut]
            else:
                n_tokens = own.encode([x.decode("utf-8", "replace") for x in texts])
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(n_tokens, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(count, _SCHEMA)


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    """Tokens of all of ``documents`` under the word BPE."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return count_tokens(docs, public_tokenizers.path("word_bpe_49k.json")).withColumn("over_limit", F.col("n_tokens") > 2048)
