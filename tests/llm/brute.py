"""Plain Python versions of the operators' definitions, and a small table that holds the odd cases."""

from __future__ import annotations

import hashlib
import math
import re
import zlib

ODD_TEXTS = [
    None, "", " ", "\n\t ", "word", "two words", "a  b   c\n\n  d ", "x<|endoftext|> y", "\x1c \x1d x", " nbsp and  line", "don't  stop\n now",
    "Mail a.b+c@mail.example.com, or x@y.z.", "a@b.c_d@e.f x@@y.z q@w", "1.2.3.4 and 256.1.1.1 then 1.2.3.4.5.6.7.8 and 001.02.3.255",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112 and 4845168114407329 9 1", "call +1 (017) 555-7713 now, +12 3 or +1234567 8 +++49 30 1234567.",
    "é1.2.3.4é +49 30 1234567 ü x@y.zé", "0" * 3000 + "." + "1" * 50, "a" * 5000 + "@" + "b" * 10, "q" * 20_000,
    "the same words again and again " * 900, "A B c d e f g h i j k l m n o p",
]


def documents(extra: list[tuple[int | None, str | None]] = ()) -> list[tuple]:
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS)] + [(None, "no id at all here"), (3, "repeated id"), (4, "word"), (4, "word")] + list(extra)
    return [(i, t, "en", "s", None if t is None else len(t), "clash") for i, t in rows]


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, `key` string"
CLASH = "doc_id long, text string, lang string, source string, n_chars long, `{}` string"


# -- URL rules ---------------------------------------------------------------------------------------------------------
RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}


def lower(s: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def split_url(url: str | None) -> tuple[str, str]:
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
    return lower(m[1]), m[2]


def canonical(url: str | None) -> str | None:
    if url is None or "://" not in url:
        return None
    host, path = split_url(url)
    before = url.split("://", 1)[1].split("#", 1)[0]
    query = before.split("?", 1)[1] if "?" in before else ""
    kept = sorted(p for p in query.split("&") if p and not re.match(r"(utm_[^=]*|ref)(=|$)", p))
    return re.sub(r"^www\.", "", host) + path.rstrip("/") + ("?" + "&".join(kept) if kept else "")


def judged(url: str | None, listed: set[str]) -> tuple:
    host, path = split_url(url)
    fits = [r for r in RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
    rule = max(fits, key=len) if fits else None
    return host, path, rule, RULES[rule] if rule else "block" if canonical(url) in listed else "allow"


# -- top-k -------------------------------------------------------------------------------------------------------------
def top_k(rows: list[tuple], queries, k: int) -> set[tuple]:
    def usable(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v)

    vectors = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and usable(v)]
    out = set()
    for q in {i for i, _ in vectors if queries(i)}:
        own = [v for i, v in vectors if i == q][0]
        best: dict[int, int] = {}
        for i, v in vectors:
            if i != q and len(v) == len(own):
                s = min(max(sum(a * b for a, b in zip(own, v, strict=True)), -2 ** 63), 2 ** 63 - 1)
                best[i] = max(best.get(i, s), s)
        ranked = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
        out |= {(q, r, i, s) for r, (i, s) in enumerate(ranked, 1)}
    return out


# -- personal data -----------------------------------------------------------------------------------------------------
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str | None) -> dict[str, list[tuple[int, int]]]:
    out = {}
    for kind, pattern in PATTERNS.items():
        out[kind] = []
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(len(p.lstrip("0")) > 3 or int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out[kind].append(m.span())
    return out


def base_digest(spans: dict) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k in PATTERNS for a, b in spans[k]).encode()).hexdigest()


# -- shingles ----------------------------------------------------------------------------------------------------------
def shingles(text: str | None, n: int) -> set[tuple]:
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    if not words:
        return set()
    return {tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))}


def components(rows: list[tuple[int, str | None]], n: int, percent: int) -> dict[int, int]:
    """Smallest id reachable, of every id; rows with one id are one node."""
    sets = [(i, shingles(t, n)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                lo, hi = sorted((find(i), find(j)))
                parent[hi] = lo
    return {i: find(i) for i in parent}


def crc(ids: list[int]) -> int:
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


# -- hard negatives ----------------------------------------------------------------------------------------------------
def hard_negatives(rows: list[tuple], anchors, positives: int, negatives: int, low: int, high: int) -> set[tuple]:
    """rows (id, vector, label); scores clipped to a long."""
    def usable(i, v, label):
        return None not in (i, v, label) and all(x is not None and math.isfinite(x) and math.isfinite(256.0 * x) for x in v)

    kept: dict[int, tuple] = {}
    for i, v, label in sorted((r for r in rows if usable(*r)), key=lambda r: (r[2], r[1])):
        kept.setdefault(i, ([math.floor(256.0 * x) for x in v], label))
    out = set()
    for a, (q, own) in kept.items():
        if not anchors(a):
            continue
        scores = [(-min(max(sum(x * y for x, y in zip(q, v, strict=True)), -2 ** 63), 2 ** 63 - 1), i, label) for i, (v, label) in kept.items()
                  if i != a and len(v) == len(q)]
        scores.sort()
        for p, pid, _ in [s for s in scores if s[2] == own][:positives]:
            fit = [s for s in scores if s[2] != own and low * -p <= 100 * -s[0] <= high * -p]
            out |= {(a, pid, rank, i, -p, -s) for rank, (s, i, _) in enumerate(fit[:negatives], 1)}
    return out


# -- prefix trie -------------------------------------------------------------------------------------------------------
def trie(rows: list[tuple]) -> list[tuple]:
    """rows (conv, turn, role, text); every column of the result but the node's hash."""
    convs: dict[int, list] = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            convs.setdefault(c, []).append(((turn is not None, turn or 0), key, (role, text)))
    plain = {c: [t[2] for t in sorted(ts, key=lambda t: t[:2])] for c, ts in convs.items()}
    built = {}
    for c, own in plain.items():
        h = zlib.crc32(str(c).encode()) % 9
        lead = c - int(math.fmod(c, 5))
        built[c] = tuple(plain.get(lead, [])[:h] + own[h:])
    members: dict[tuple, list[int]] = {}
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members.setdefault(ts[:d], []).append(c)
    out = []
    for p, cs in members.items():
        under = [x for x in members if x[:len(p)] == p]
        kids = {x for x in members if len(x) == len(p) + 1 and x[:-1] == p}
        leaves = sum(not any(y[:len(x)] == x and len(y) > len(x) for y in members) for x in under)
        saved = sum((len(members[x]) - 1) * (len(x[-1][1].encode()) if x else 0) for x in under)
        ends = ",".join(str(c) for c in sorted(cs) if built[c] == p)
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


# -- identifiers by context --------------------------------------------------------------------------------------------
def _candidates(text: str) -> list[tuple]:
    """(start, end, value, patterns): tokens with a digit or @ and the groups of digits behind them, walked token by token."""
    tokens = [(m.start(), m.end(), m.group()) for m in re.finditer(r"[^ \t-\r]+", text)]
    closing, runs, i = "\"')]>},;:.!?", [], 0
    while i < len(tokens):
        lo, hi, word = tokens[i]
        i += 1
        if not re.search("[0-9@]", word):
            continue
        while (i < len(tokens) and text[hi - 1] in "0123456789)" and tokens[i][0] == hi + 1 and text[hi] == " "
               and re.fullmatch(r"\(?[0-9][0-9()-]*", tokens[i][2].rstrip(closing))):
            hi, i = tokens[i][1], i + 1
        runs.append((lo, hi))
    trim = lambda w: re.sub(r"^[!-\"$-/;<>-@\[-`{-~]+|[!-\"$-/;<>-@\[-`{-~]+$", "", w).lower()  # noqa: E731   not # : =
    out = []
    for k, (lo, hi) in enumerate(runs):
        left = text[runs[k - 1][1] if k else 0:lo][-200:].split()
        right = text[hi:runs[k + 1][0] if k + 1 < len(runs) else len(text)][:200].split()
        start = lo + len(re.match(r"[\"'(\[<{=:,;]*", text[lo:hi]).group())
        end = max(start, lo + len(text[lo:hi].rstrip(closing)))
        l1, l2, r1 = (trim(w[0]) if w else "" for w in (left[-1:], left[-2:-1], right[:1]))
        patterns = ([f"L {l2} {l1}"] if l1 and l2 else []) + ([f"B {l1} {r1}"] if l1 and r1 else [])
        if end > start:
            out.append((start, end, text[start:end].lower().replace(" ", ""), patterns))
    return out


def identifiers(texts: list[str], rounds: int = 3, confidence: float = 0.9, instances: int = 5, least: int = 3, digits: int = 6) -> dict[str, list[tuple]]:
    """Per distinct text, the spans that contexts find beyond the base patterns' matches."""
    found = []
    for t in set(texts):
        base = [s for spans in base_spans(t).values() for s in spans]
        found += [(t, a, b, v, p, any(x < b and y > a for x, y in base)) for a, b, v, ps in _candidates(t) for p in ps]
    looks = lambda v: len(re.sub("[^0-9]", "", v)) >= digits or "@" in v
    base_seed = {f[3] for f in found if f[5]}
    members: dict[str, set] = {}
    for _, _, _, v, p, _ in found:
        members.setdefault(p, set()).add(v)
    seeds, score, sure = set(base_seed), {}, {}
    for turn in range(rounds):
        sure = {}
        for p, vs in members.items():
            mean = sum(1.0 if v in base_seed else score.get(v, 0.0) for v in vs) / len(vs)
            if len(vs) >= instances and len(vs & seeds) >= least and mean >= (confidence if turn == rounds - 1 else confidence / 2):
                sure[p] = mean
        doubt, seeds = {}, set(base_seed)
        for p, s in sure.items():
            for v in members[p]:
                doubt[v] = doubt.get(v, 1.0) * max(1 - s, 1e-6)
                if s >= confidence and looks(v):
                    seeds.add(v)
        score = {v: 1 - d for v, d in doubt.items()}
    out: dict[str, set] = {t: set() for t in texts}
    for t, a, b, v, p, seed in found:
        if not seed and looks(v) and p in sure:
            out[t].add((a, b))
    return {t: sorted(s) for t, s in out.items()}
