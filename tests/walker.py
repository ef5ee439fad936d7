"""Markup read token by token in plain Python, for comparison."""

import re

from lorestack.functions import markup as M

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[^>]*(?:>|\Z)|[^<]+", re.S)
SPACES = "\t\n\x0b\x0c\r \x85\xa0"


def tokens(markup):
    return TOKEN.findall(markup)


def name(tag):
    found = re.split(r"[ \t\n\r/>]", tag[1:].lstrip("/").lstrip(), maxsplit=1)[0]
    return found.rsplit(":", 1)[-1].lower()


def end(ts, i):
    """The last token of what begins at token i."""
    t = ts[i]
    if not t.startswith("<") or t[:2] in ("<!", "<?") or not t.endswith(">") or t.endswith("/>") or name(t) in M.VOID:
        return i
    deep = 1
    for j in range(i + 1, len(ts)):
        u = ts[j]
        if u.startswith("<") and not u.startswith("<!") and name(u) == name(t):
            deep += -1 if u.startswith("</") else 0 if u.endswith("/>") else 1
            if not deep:
                return j
    return len(ts) - 1


def decode(text):
    def one(m):
        b = m[1]
        if not b.startswith("#"):
            return M.ENTITIES.get(b, m[0])
        code = int(b[2:], 16) if b[1] in "xX" else int(b[1:])
        return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else m[0]

    return re.sub(r"&(#[xX][0-9a-fA-F]{1,10}|#[0-9]{1,11}|[A-Za-z]{1,12});", one, text)


def visible(ts):
    out, i = [], 0
    while i < len(ts):
        if not ts[i].startswith("<"):
            out.append(ts[i])
        elif not ts[i].startswith("<!--") and name(ts[i]) in M.OPAQUE:
            i = end(ts, i)
        i += 1
    return " ".join(decode("".join(out)).split())


def blocks(markup):
    ts, out, i = tokens(markup), [], 0
    while i < len(ts):
        j = end(ts, i)
        if (block := "".join(ts[i : j + 1]).strip(SPACES)) and not re.fullmatch(r"[ \t\n\r\f]*", "".join(ts[i : j + 1])):
            out.append(block)
        i = j + 1
    return out


def peel(ts):
    if not ts[0].startswith("<") or ts[0].startswith("<!--") or not ts[0].endswith(">") or ts[0].endswith("/>") or name(ts[0]) in M.VOID:
        return None
    return max((i for i, t in enumerate(ts) if i and t.startswith("</")), default=None)


def held(block):
    ts = tokens(block)
    close = peel(ts)
    if close is None:
        return "", "", " ".join(decode(block).split()), []
    inner, out, tags, i = ts[1:close], "", [], 0
    while i < len(inner):
        j = end(inner, i)
        part = inner[i : j + 1]
        if not part[0].startswith("<"):
            out += decode(part[0])
        else:
            shut = peel(part)
            tags.append(["".join(part), ""] if shut is None else [part[0], "".join(part[shut:])])
            out += f"⟦{len(tags)}⟧{'' if shut is None else visible(part[1:shut])}⟦/{len(tags)}⟧"
        i = j + 1
    return ts[0], "".join(ts[close:]).strip(SPACES), out.strip(SPACES), tags


def escape(text):
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def rebuilt(block, translated):
    opened, closed, _, tags = held(block)
    stack, seen, out, right = [], [], "", True
    for p in re.findall("⟦[^⟧]*⟧|[^⟦]+|⟦", translated):
        m = re.fullmatch(r"⟦(/?)(\d+)⟧", p)
        if not p.startswith("⟦"):
            out += escape(p)
        elif not m or not 1 <= int(m[2]) <= len(tags) or (m[1] and (not stack or stack.pop() != m[2])) or (not m[1] and m[2] in seen):
            right = False
            break
        else:
            if not m[1]:
                stack.append(m[2])
                seen.append(m[2])
            out += tags[int(m[2]) - 1][1 if m[1] else 0]
    if not right or stack or len(seen) != len(tags):
        out = escape(re.sub("⟦[^⟧]*⟧|⟦", "", translated))
    return opened + out + closed


def pages(text, budget=2_500, image=700):
    """Character by character."""
    starts = [[m.end() for m in re.finditer(p, text) if m.end() < len(text)] for p in (r"[ \t\r\f]*\n[ \t\r\f]*\n[ \t\r\n\f]*", r"[.!?…][\"')\]»”’]*\s+(?=[^\s.!?…])")]
    out, start = [], 0
    while start < len(text) and text.strip():
        spent, stop = 0, len(text)
        for i in range(start, len(text)):
            if spent >= budget:
                stop = i
                break
            spent += 1 + image * text.startswith("[[image: ", i)
        if stop < len(text):
            stop = next((near[-1] for near in ([b for b in some if start < b <= stop] for some in starts) if near), stop)
        out.append(text[start:stop])
        start = stop
    return out
