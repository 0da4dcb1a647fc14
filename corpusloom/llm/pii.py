"""Personal data: base patterns, and further spans that boosted trees pick from the proposals of high-recall generators.

Base patterns (email, ip, card, phone) are found exactly. Generators propose wider, overlapping forms: addresses with "(at)" and
"dot" in words or brackets with domains of any depth, numbers of 12 to 19 digits with any separators as cards, runs of 7 to 15
digits in groups as telephone numbers. They propose dates, lists and measures too; it is the trees that leave those alone.
Trees of each kind score a proposal by its form (length, digits, separators, letters) and its context (signs and words before and
after). Nothing marks such forms in a corpus, so examples are made: the base spans of a bounded sample of documents, and some
of a fixed kind so that none is without, are disguised where they stand (no plus sign, other separators, "(at)") as positive
examples; negative ones are the same forms with digits that break the check (Luhn, parts of over 255), dates, moments, lists and
measures, or spans glued to other letters and digits. The trees are calibrated on a part held back. For each kind the threshold is
the lowest probability, 0.5 at least, from which at most `tolerance` of the held-back examples accepted are negative.
Accepted proposals never overlap base spans; of overlapping ones the more probable stays (ties: the later start, then end).

Offsets are in code points, ends exclusive. Defined results: null and empty texts have no spans (base_sha256 of an empty
string); repeated rows are scanned each; texts of any length are scanned whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.boosting import BoostedTrees

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
#: From a run's first digit on and without backtracking, which gives the same matches in linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_LOCAL_SIGNS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SIGNS, _AT, _DOT = r"[A-Za-z0-9._%+-]", r"(?:@|\s?[\[(]\s?at\s?[\])]\s?|\sat\s)", r"(?:\.|\s?[\[(]\s?dot\s?[\])]\s?|\sdot\s)"
_IP_DOT, _CUT = r"(?:\.|\s?[\[(]\s?(?:\.|dot)\s?[\])]\s?)", r"[^0-9A-Za-z]?"
#: Proposals that aren't base patterns by themselves: (kind, what the text must hold, pattern, least and most digits). Runs are
#: entered at their first sign only and never given back, so long ones cost no more than their length.
_WIDER = (
    ("email", re.compile("@|at", re.I), re.compile(rf"(?<!{_SIGNS}){_SIGNS}++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++", re.I), 0, None),
    ("ip", _DIGIT, re.compile(rf"(?<![0-9.])[0-9]{{1,3}}(?:{_IP_DOT}[0-9]{{1,3}}){{3}}(?![0-9.])", re.I), 4, 12),
    # groups of four, groups as on cards of 15 digits, and groups of any sizes between signs that are all the same
    ("card", _DIGIT, re.compile(rf"(?<![0-9])[0-9]{{4}}(?:{_CUT}[0-9]{{4}}){{2,3}}(?:{_CUT}[0-9]{{1,3}})?(?![0-9])"), 12, 19),
    ("card", _DIGIT, re.compile(rf"(?<![0-9])[0-9]{{4}}{_CUT}[0-9]{{6}}{_CUT}[0-9]{{5}}(?![0-9])"), 15, 15),
    ("card", _DIGIT, re.compile(r"(?<![0-9])[0-9]++([^0-9A-Za-z]{1,3})[0-9]++(?:\1[0-9]++)*+"), 12, 19),
    # three, three and four digits, and whole runs of digits and their signs
    ("phone", _DIGIT, re.compile(r"(?<![0-9+])(?:\+?[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)\s?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"), 10, 13),
    ("phone", _DIGIT, re.compile(r"(?<![0-9(+])[(+]{0,2}[0-9]++(?:[() ./-]{1,3}[0-9]++)++"), 7, 15),
)


def luhn(digits: str) -> bool:
    odd = [int(d) for d in reversed(digits)]
    return sum(odd[0::2] + [d * 2 - 9 * (d > 4) for d in odd[1::2]]) % 10 == 0


def _emails(text: str):
    """Matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+ from left to right, sought at each @."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_SIGNS:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in order of start, then of KINDS."""
    found = [(a, b, "email") for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                    found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def proposals(text: str) -> list[tuple[int, int, str]]:
    """Distinct spans, which may overlap."""
    found = set()
    for kind, needs, pattern, least, most in _WIDER:
        if needs.search(text):
            for m in pattern.finditer(text):
                if most is None or least <= len(_DIGIT.findall(m.group())) <= most:
                    found.add((m.start(), m.end(), kind))
    return sorted(found)


_WORDS = {"email": ("mail", "contact", "@"), "ip": ("ip", "host", "server", "addr"), "card": ("card", "visa", "pay", "credit"), "phone": ("tel", "phone", "call", "fax")}


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    span, before, after = text[start:end], text[max(0, start - 24) : start], text[end : end + 8]
    digits = "".join(c for c in span if "0" <= c <= "9")
    groups = re.findall("[0-9]+", span)
    return [
        float(KINDS.index(kind)), len(span), len(digits), sum(c.isalpha() for c in span), sum(c in " -." for c in span), sum(c in "()[]/_" for c in span),
        len(groups), max(map(len, groups), default=0), float(max(map(int, groups), default=0) > 255) if kind == "ip" else 0.0, float(luhn(digits)) if kind == "card" and digits else 0.0,
        float(before[-1:].isspace() or not before), float(before[-1:] == "+"), float(before[-1:].isalnum()), float(before[-1:] in "\"'=#/._-" if before else 0),
        float(after[:1].isspace() or not after), float(after[:1].isalnum()), float(any(w in before.lower() for w in _WORDS[kind])), sum(c.isdigit() for c in before), sum(c.isdigit() for c in after),
        min(map(len, groups), default=0), len(groups[0]) if groups else 0, len(groups[-1]) if groups else 0, float("@" in span), float(" at " in span.lower()), float(span.lower().count("dot")), span.count("."), float(len(set(re.findall("[^0-9A-Za-z]+", span))) == 1), float(groups[0][0] == "0") if groups else 0.0, span.count("-"), span.count("/"), span.count("("),
    ]


def disguises(span: str, kind: str, rng: np.random.Generator) -> tuple[str, list[str]]:
    """(a form that only the generators reach, forms that look like it but are no personal data)."""
    digits = [c for c in span if "0" <= c <= "9"]
    other = lambda n, low=0: "".join(str(d) for d in rng.integers(low, 10, n))
    day = lambda sign: f"{rng.integers(1900, 2100)}{sign}{rng.integers(1, 13):02}{sign}{rng.integers(1, 29):02}"
    clock = lambda sign: sign.join(f"{x:02}" for x in rng.integers(0, 60, 3))
    if kind == "email":
        local, host = span.rsplit("@", 1)
        at, dot = ((" (at) ", " (dot) "), (" [at] ", " [dot] "), ("(at)", "."), ("[at]", "[dot]"), (" at ", " dot "), ("@", " dot "))[rng.integers(6)]
        return local + at + host.replace(".", dot), [f"{local} at {host}", f"{local}@{host.split('.')[0]}", f"{local} at {host.split('.')[0]}. Then"]
    if kind == "ip":
        dot = ("[.]", "(.)", "[dot]", " (dot) ")[rng.integers(4)]
        return span.replace(".", dot), [dot.join(other(3, 3) for _ in range(4)), ".".join(other(3, 3) for _ in range(4))]
    if kind == "card":
        sign = ("/", ".", "_", " / ", ":", " - ", "\u00a0")[rng.integers(7)]
        n = int(rng.choice([12, 13, 14, 15, 16, 16, 16, 16, 19]))
        ds = ("".join(digits) + other(19))[: n - 1]
        ds += next(str(d) for d in range(10) if luhn(ds + str(d)))
        cuts = [4, 10] if n == 15 else [4, 10] if n == 14 else list(range(4, n, 4))
        shaped = lambda ds: sign.join(ds[i:j] for i, j in zip([0, *cuts], [*cuts, n]))
        # the moments and lists of small numbers are held to the check digit too, so that their form must tell them apart
        while not luhn(moment := day("").replace("/", "") + clock("")):
            pass
        while not luhn("".join(few := list(map(str, rng.integers(10, 100, 8))))):
            pass
        moments = (f"{moment[:4]}-{moment[4:6]}-{moment[6:8]}-{moment[8:10]}-{moment[10:12]}-{moment[12:]}", f"{moment[:8]}-{moment[8:]}")
        return shaped(ds), [*(shaped(ds[:-1] + str((int(ds[-1]) + 1 + int(rng.integers(9))) % 10)) for _ in range(2)), moments[rng.integers(2)], (", ", "/", " ")[rng.integers(3)].join(few)]
    ds = ("".join(digits) + other(12))[-12:]
    a, b, c, d = ds[:2], ds[2:5], ds[5:8], ds[8:]
    shape = ("({b}) {c}-{d}", "{b}-{c}-{d}", "{b}.{c}.{d}", "{b} {c} {d}", "{c}-{d}", "00{a}-{b}-{c}{d}", "0{b}/{c}{d}", "({b}) {c}{d}", "+{a} ({b}) {c} / {d}", "{a} {b} {c} {d}", "+1 ({b}) {c}-{d}", "+{a} {b} {c} {d}")[rng.integers(12)].format(a=a, b=b, c=c, d=d)
    plain = f"{b}-{c}-{d}"
    wrong = [day(("-", "/", ".")[rng.integers(3)]), f"{day('-')} {clock(' ')}", f"{rng.integers(1900, 2100)}-{rng.integers(1900, 2100)}", f"{rng.integers(1, 10)}.{other(7)}", f"{other(2, 1)} {other(3)} {other(3)}", " ".join(map(str, rng.integers(1, 100, 6))), f"{other(4, 1)} {other(4)}", f"{other(3, 1)} / {other(5, 1)}"]
    return shape, ["#" + plain + other(3), other(1) + "." + plain, *(wrong[i] for i in rng.permutation(len(wrong))[:3])]


def examples(text: str, base: list[tuple[int, int, str]]):
    """(kind, label, features) of the disguises of a text's base spans, as the generators propose them."""
    for start, end, kind in base:
        rng = np.random.default_rng([start, end, zlib.crc32(text.encode())])
        good, bad = disguises(text[start:end], kind, rng)
        # some are followed by another number, which the longer proposals then take in
        right = f" {rng.integers(1000)}.{rng.integers(1000)}" * int(rng.integers(3) == 0) + text[end : end + 64]
        left = text[max(0, start - 64) : start]
        for label, form in [(1, good), *((0, f) for f in bad)]:
            made = left + form + right
            for a, b, k in proposals(made):
                if k == kind and a < len(left) + len(form) and b > len(left):
                    whole = abs(a - len(left)) <= 1 and abs(b - len(left) - len(form)) <= 1
                    yield kind, int(label and whole), features(made, a, b, kind)


def seeds(n: int = 150) -> list[str]:
    """Plain texts with one base span each."""
    rng, out = np.random.default_rng(17), []
    for i in range(n):
        digits = "".join(map(str, rng.integers(0, 10, 15)))
        digits += next(str(d) for d in range(10) if luhn(digits + str(d)))
        word = "".join(map(chr, rng.integers(97, 123, 6)))
        out += [f"write to {word}@{word[::-1]}.org today", "from " + ".".join(map(str, rng.integers(1, 255, 4))) + " it came", f"paid by {digits} then", f"call +1{digits[:10]} now"]
    return out


def _samples(batches):
    for batch in batches:
        rows = [x for text in batch.column(0).to_pylist() for x in examples(text or "", base_spans(text or ""))]
        kinds, labels, xs = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(labels, pa.int32()), pa.array(xs, pa.list_(pa.float64()))], names=["kind", "label", "x"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 6000, most_rows: int = 20_000, tolerance: float = 0.02) -> dict:
    """Trees and thresholds, from the base spans of at most sample_docs documents (those with the least hash of doc_id) and most_rows examples."""
    ids = docs.select(F.col(id_col).alias("doc_id")).orderBy(F.xxhash64("doc_id")).limit(sample_docs)
    sample = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "doc_id", "left_semi")  # at most sample_docs rows
    rows = sample.select("text").mapInArrow(_samples, "kind string, label int, x array<double>").orderBy(F.xxhash64("x")).limit(most_rows).collect()
    rows = [(r.kind, r.label, r.x) for r in rows] + [e for t in seeds() for e in examples(t, base_spans(t))]
    x, y, kind = np.array([r[2] for r in rows]), np.array([r[1] for r in rows], float), np.array([r[0] for r in rows])
    held = np.random.default_rng(7).random(len(y)) < 1 / 3
    trees, thresholds = {}, {}
    for k in KINDS:
        fitted, back = (kind == k) & ~held, (kind == k) & held
        trees[k] = BoostedTrees().fit(x[fitted], y[fitted]).calibrate(x[back], y[back])
        p = trees[k].probability(x[back])
        order = np.argsort(-p, kind="stable")
        wrong, s = np.cumsum(1 - y[back][order]), p[order]
        right = np.flatnonzero((wrong <= tolerance * np.arange(1, len(s) + 1)) & (np.append(s[1:], -1.0) < s))
        # halfway to the best one refused, so that forms a little less usual than the accepted ones are not lost
        thresholds[k] = max(0.5, float(s[right[-1]] + np.append(s, 0.0)[right[-1] + 1]) / 2) if len(right) else 0.9
    return {"trees": trees, "thresholds": thresholds}


def all_spans(text: str, model: dict) -> tuple[list, list]:
    """(base spans, all spans)."""
    base = base_spans(text)
    wide = [p for p in proposals(text) if all(p[1] <= a or b <= p[0] for a, b, _ in base)]
    if not wide:
        return base, base
    x, scores = np.array([features(text, *p) for p in wide]), np.zeros(len(wide))
    for k in {p[2] for p in wide}:
        mine = np.array([p[2] == k for p in wide])
        scores[mine] = model["trees"][k].probability(x[mine])
    more: list = []
    for score, p in sorted(zip(scores, wide), reverse=True):
        if score >= model["thresholds"][p[2]] and all(p[1] <= a or b <= p[0] for a, b, _ in more):
            more.append(p)
    return base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced by its kind in brackets; of spans that overlap, their union by the first kind."""
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def find(docs: DataFrame, model: dict | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans."""
    model = model or fit(docs, id_col, text_col)

    def run(batches):
        for batch in batches:
            counts, digests, lists = [], [], []
            for text in batch.column(1).to_pylist():
                base, spans = all_spans(text or "", model)
                counts.append([sum(k == kind for _, _, k in base) for kind in KINDS])
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                lists.append(joined(spans))
            numbers = [pa.array([c[i] for c in counts], pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *numbers, pa.array(digests, pa.string()), pa.array(lists, pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(docs: DataFrame, model: dict | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the spans in its text replaced; a null text stays null."""
    model = model or fit(docs, id_col, text_col)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts = [None if t is None else redacted(t, all_spans(t, model)[1]) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(texts, batch.schema.field(at).type), *batch.columns[at + 1 :]], names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
