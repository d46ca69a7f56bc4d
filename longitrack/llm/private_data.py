"""Personal data by a character-level BiLSTM with CRF transitions, beside plain patterns.

The patterns give the base spans, which always stay. The network is trained on labelled spans: generated
addresses and numbers in the spellings people use to dodge patterns, planted in passages of the corpus. A text
is cut into overlapping windows, every window is decoded, and the spans of all windows are reconciled over the whole
text: pieces cut by a window's edge are joined, and of overlapping spans those with the greatest total score stay.
"""

from __future__ import annotations

import bisect
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from longitrack.llm.char_tagger import KINDS, CharTagger, classes

# Code points of a window, and between the starts of two windows.
WINDOW = 128
STRIDE = 64
# Windows decoded at a time.
ROWS = 512
# Training: passages of the corpus at most, code points of each, generated rows and code points of a row.
PASSAGES = 300
PASSAGE = 160
GENERATED = 5_000
ROW = 96
# Score a reconciled span must reach: the sum of its tags' margins over being outside.
LEAST_SCORE = 3.0

Span = tuple[int, int, str]  # start, end (exclusive), kind

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
# Possessive, and begun at the first digit of a run only, so that no digit is tried twice.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SPELLED_AT = r"[\[({]at[\])}]"
_SPELLED_DOT = r"[\[({ ](?:dot|punkt|point|punto)[\])} ]"
# Every span that ``plausible`` accepts holds one of these.
_ANCHOR = re.compile(rf"[0-9@]|{_SPELLED_AT}|{_SPELLED_DOT}", re.IGNORECASE)
_EMAIL_LIKE = re.compile(
    rf"[\w.%+-]+\s?(?:@|{_SPELLED_AT}|\sat\s)\s?[\w-]+(?:\s?(?:\.|[\[(]\.[\])]|{_SPELLED_DOT})\s?[\w-]+)+", re.IGNORECASE)
_IP_LIKE = re.compile(r"[0-9]{1,3}(?:(?:\.|[\[(]\.[\])]| \. )[0-9]{1,3}){3}")
_CARD_LIKE = re.compile(r"[0-9](?:[ ./_-]?[0-9])+")
_PHONE_LIKE = re.compile(r"(?:\+|00|\(?0|\()?[0-9][0-9 ()./-]*[0-9]")


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number is right."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def base_spans(text: str) -> list[Span]:
    """Matches of the plain patterns, leftmost and non-overlapping for each kind, by start and kind.

    The time is linear in the text: an address is looked for around its at sign.
    """
    out: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        left = at
        while left > done and _LOCAL.match(text, left - 1):
            left -= 1
        found = _DOMAIN.match(text, at + 1) if left < at else None
        if found:
            done = found.end()
            out.append((left, done, "email"))
        at = text.find("@", at + 1)
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in m.group().split(".")):
            out.append((*m.span(), "ip"))
    for m in _CARD.finditer(text):
        if 12 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append((*m.span(), "card"))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m.group())) <= 15:
            out.append((*m.span(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def plausible(text: str, start: int, end: int, kind: str) -> bool:
    """Exact conditions on a span of the network: a whole token of the shape, range and checksum of its kind."""
    own = text[start:end]
    before, after = text[start - 1:start], text[end:end + 1]
    if (before.isalnum() and own[:1].isalnum()) or (after.isalnum() and own[-1:].isalnum()):
        return False
    if kind == "email":
        return _EMAIL_LIKE.fullmatch(own) is not None and _ANCHOR.search(own) is not None
    digits = _digits(own)
    if kind == "ip":
        return _IP_LIKE.fullmatch(own) is not None and all(int(part) <= 255 for part in re.findall("[0-9]+", own))
    if kind == "card":
        return _CARD_LIKE.fullmatch(own) is not None and 12 <= len(digits) <= 19 and luhn(digits)
    # Digits alone are a number of any sort; a call number shows by a plus, a leading zero or its groups.
    grouped = own[0] in "+0(" or len(re.findall("[0-9]+", own)) >= 3
    return grouped and _PHONE_LIKE.fullmatch(own) is not None and 9 <= len(digits) <= 15


def _pick(rnd: random.Random, *options: str) -> str:
    return rnd.choice(options)


def _number(rnd: random.Random, n: int, first: str = "0123456789") -> str:
    return rnd.choice(first) + "".join(rnd.choice("0123456789") for _ in range(n - 1))


def _word(rnd: random.Random, words: list[str]) -> str:
    plain = re.sub("[^a-z]", "", rnd.choice(words).lower()) if words else ""
    return plain or _pick(rnd, "anna", "info", "mail", "peter", "office", "lee", "kim", "web")


def generated_span(rnd: random.Random, kind: str, words: list[str]) -> str:
    """An invented address or number in one of its usual or disguised spellings."""
    if kind == "email":
        at, dot = rnd.choice([("@", "."), ("@", "."), ("@", "."), (" at ", " dot "), (" (at) ", " (dot) "), ("[at]", "[dot]"),
                              ("(at)", "."), (" [at] ", "."), (" @ ", "."), ("@", "[.]"), ("[at]", "."), ("{at}", "{dot}"), (" at ", " punkt ")])
        local = _pick(rnd, ".", "_", "-", "").join(_word(rnd, words) for _ in range(rnd.randint(1, 2)))
        local += _number(rnd, rnd.randint(1, 3)) if rnd.random() < 0.3 else ""
        domain = [_word(rnd, words) + (str(rnd.randint(0, 9)) if rnd.random() < 0.3 else "") for _ in range(rnd.randint(1, 2))]
        return local + at + dot.join([*domain, _pick(rnd, "com", "org", "net", "de", "fr", "es", "io", "edu")])
    if kind == "ip":
        return _pick(rnd, ".", ".", ".", "[.]", "(.)", " . ").join(str(rnd.randint(0, 255)) for _ in range(4))
    if kind == "card":
        size = rnd.choice([16, 16, 16, 16, 15, 13, 19])
        body = _number(rnd, size - 1, "3456")
        digits = next(body + c for c in "0123456789" if luhn(body + c))
        groups = [digits[:4], digits[4:10], digits[10:]] if size == 15 else [digits[i:i + 4] for i in range(0, size, 4)]
        return _pick(rnd, "", "", " ", "-", ".", "/", "_").join(groups)
    a, b, c = _number(rnd, 3), _number(rnd, 3), _number(rnd, 4)
    far = _number(rnd, rnd.randint(1, 2), "123456789")
    return rnd.choice([
        f"+{far} ({a}) {b}-{c}", f"+{far} {a} {b} {c}", f"+{far}-{a}-{b}-{c}", f"+{far}{a}{b}{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}",
        f"{a}.{b}.{c}", f"00{far} {a} {b}{c}", f"0{a}/{b}{c}", f"0{a} {b} {c}", f"0{a}-{b}{c}", f"{a} {b} {c}", f"00{far}-{a}-{b}-{c}",
    ])


def _decoy(rnd: random.Random, words: list[str]) -> str:
    """Something with digits or signs that is no personal data."""
    return rnd.choice([
        lambda: "token = \"" + "".join(rnd.choice("0123456789abcdef") for _ in range(rnd.choice([24, 32, 40]))) + "\"",
        lambda: f"{rnd.randint(0, 9)}.{rnd.randint(0, 9)}", lambda: f"version {rnd.randint(0, 9)}.{rnd.randint(0, 20)}.{rnd.randint(0, 20)}",
        lambda: f"{rnd.randint(1900, 2030)}-{rnd.randint(1, 12):02}-{rnd.randint(1, 28):02}",
        lambda: f"{rnd.randint(1, 28):02}.{rnd.randint(1, 12):02}.{rnd.randint(1900, 2030)}",
        lambda: f"{rnd.randint(0, 23):02}:{rnd.randint(0, 59):02}", lambda: f"${rnd.randint(1, 999)},{rnd.randint(0, 999):03}.00",
        lambda: str(rnd.randint(1, 10 ** rnd.randint(1, 11))), lambda: f"No. {_number(rnd, rnd.randint(4, 11), '123456789')}",
        lambda: f"{rnd.randint(1900, 2030)}-{rnd.randint(1900, 2030)}", lambda: "@" + _word(rnd, words),
        lambda: f"{rnd.randint(1, 99)}.{rnd.randint(0, 9)} %", lambda: f"#{rnd.randint(1, 99999)}", lambda: "AKIA" + _number(rnd, 16),
        lambda: "look at the dot on the line", lambda: f"{rnd.randint(1, 9)}.{rnd.randint(1, 9)}.{rnd.randint(1, 9)}",
    ])()


def labelled_rows(passages: list[str], count: int = GENERATED, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Class numbers and tags of ``count`` rows: passages with spans and decoys planted between their words.

    Matches of the patterns in the passages are labelled as well. A row starts at a drawn place, so that
    spans are cut by its edges as they are by those of a window.
    """
    rnd = random.Random(seed)
    words = [w for p in passages for w in p.split()]
    rows, tags = np.zeros((count, ROW), np.uint8), np.zeros((count, ROW), np.int64)
    for k in range(count):
        parts = (rnd.choice(passages) if passages else "").split(" ")
        parts = parts[:rnd.randint(1, max(1, len(parts)))]
        text, labels = "", []
        for _ in range(rnd.choice([1, 1, 2, 3])):
            cut = rnd.randint(0, len(parts))
            text += " ".join(parts[:cut]) + rnd.choice(["", " ", " ", " ", "\n", ": "] if cut else [""])
            parts = parts[cut:]
            if rnd.random() < 0.6:
                kind = rnd.choice(KINDS)
                own = generated_span(rnd, kind, words)
                labels.append((len(text), len(text) + len(own), kind))
            else:
                own = _decoy(rnd, words)
            # Like the texts with noise after every word, or in capitals.
            text += own + rnd.choice([" ", " ", " ", ", ", ".\n", "!! ", "*** ", "$$$ ", " | ", ") "])
        text += " ".join(parts)
        if rnd.random() < 0.1:
            text = text.upper() if len(text.upper()) == len(text) else text
        planted = [s for a, b, _ in labels for s in (a, b)]
        labels += [s for s in base_spans(text) if not any(a < s[1] and s[0] < b for a, b, _ in labels)] if planted or text else []
        first = rnd.randint(0, max(0, len(text) - ROW)) if rnd.random() < 0.7 else max(0, min(planted, default=0) - rnd.randint(0, ROW // 2))
        code = classes(text[first:first + ROW])
        rows[k, :len(code)] = code
        for a, b, kind in labels:
            tag, a, b = 1 + 2 * KINDS.index(kind), a - first, b - first
            if b > 0 and a < len(code):
                tags[k, max(a, 0):b] = tag + 1
                if a >= 0:
                    tags[k, a] = tag
    keep = rows[:, 0] > 0
    return rows[keep], tags[keep]


def corpus_passages(docs: DataFrame, limit: int = PASSAGES) -> list[str]:
    """At most ``limit`` passages of ``PASSAGE`` code points, one from each document of a sample by hash of the id."""
    drawn = F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))
    start = F.pmod(drawn, F.greatest(F.length("text") - PASSAGE, F.lit(1))) + 1
    rows = docs.where(F.length("text") > 0).select(
        drawn.alias("h"), F.substring(F.col("text"), start.cast("int"), F.lit(PASSAGE)).alias("passage")).orderBy("h", "passage").limit(limit)
    return [r["passage"] for r in rows.collect()]


def train_tagger(passages: list[str], seed: int = 0) -> CharTagger:
    """The network, trained on generated rows over ``passages``."""
    tagger = CharTagger.untrained(seed)
    tagger.fit(*labelled_rows(passages, seed=seed), seed=seed)
    return tagger


def window_starts(size: int) -> range:
    """Starts of the windows that cover ``size`` code points."""
    return range(0, max(1, size - WINDOW + STRIDE), STRIDE) if size else range(0)


def windows_with_anchor(text: str) -> list[int]:
    """Starts of the windows that hold a whole anchor. As every accepted span holds one, no other window,
    decoded on its own, could give a span."""
    last = len(window_starts(len(text))) - 1
    found: list[int] = []
    for m in _ANCHOR.finditer(text):
        first = max(0, -(-(m.end() - WINDOW) // STRIDE), found[-1] + 1 if found else 0)
        found.extend(range(first, min(last, m.start() // STRIDE) + 1))
    return [k * STRIDE for k in found]


def tag_spans(tags: list[int], margins: list[float], start: int) -> list[tuple[int, int, str, float]]:
    """Spans of a row of tags, shifted by ``start``, with the sum of their margins."""
    out, at = [], 0
    while at < len(tags):
        if not tags[at]:
            at += 1
            continue
        kind, first = (tags[at] - 1) // 2, at
        at += 1
        while at < len(tags) and tags[at] == 2 + 2 * kind:
            at += 1
        out.append((start + first, start + at, KINDS[kind], sum(margins[first:at])))
    return out


def reconciled(text: str, decoded: list[tuple[int, list[tuple[int, int, str, float]]]], base: list[Span], least: float = LEAST_SCORE) -> list[Span]:
    """Spans of one text from (window start, spans) of its windows, ascending.

    Pieces of one kind that touch the inner edges of their windows are joined with those of the next windows they
    overlap. Of spans that overlap, the set with the greatest total score stays. Spans that are not plausible,
    score less than ``least`` or overlap a base span go.
    """
    found: dict[Span, float] = {}
    open_: list[tuple[int, int, str, float]] = []
    for start, spans in decoded:
        end = min(start + WINDOW, len(text))
        cut = []
        for a, b, kind, score in spans:
            if a == start and start > 0:  # goes on from the window before, if that one saw it too
                for c, d, other, more in open_:
                    if other == kind and c < a <= d:
                        a, score = c, score + more
                        break
            if b == end and end < len(text):
                cut.append((a, b, kind, score))
            elif a != start or start == 0:
                found[a, b, kind] = max(score, found.get((a, b, kind), 0.0))
        open_ = cut
    firsts = [a for a, _, _ in base]
    ends = [0]
    for _, b, _ in base:
        ends.append(max(ends[-1], b))
    kept = sorted(
        (b, a, kind, score) for (a, b, kind), score in found.items()
        if score >= least and ends[bisect.bisect_left(firsts, b)] <= a and plausible(text, a, b, kind))
    best, chosen = [0.0], []
    for b, a, kind, score in kept:
        before = bisect.bisect_right(kept, a, key=lambda s: s[0])
        chosen.append((score + best[before] > best[-1], before))
        best.append(max(best[-1], score + best[before]))
    out, k = [], len(kept)
    while k:
        take, before = chosen[k - 1]
        if take:
            b, a, kind, _ = kept[k - 1]
            out.append((a, b, kind))
        k = before if take else k - 1
    return out[::-1]


def network_spans(texts: list[str], base: list[list[Span]], tagger: CharTagger, every_window: bool = False) -> list[list[Span]]:
    """Spans that the network adds to ``base``, for every text; ``every_window`` decodes windows without an anchor too."""
    jobs = [(i, start) for i, text in enumerate(texts) for start in (window_starts(len(text)) if every_window else windows_with_anchor(text))]
    decoded: dict[int, list] = {}
    for at in range(0, len(jobs), ROWS):
        own = jobs[at:at + ROWS]
        rows = np.zeros((len(own), WINDOW), np.uint8)
        for row, (i, start) in zip(rows, own):
            code = classes(texts[i][start:start + WINDOW])
            row[:len(code)] = code
        tags, margins = tagger.decode(rows)
        for (i, start), some, tag, margin in zip(own, tags.any(1).tolist(), tags, margins):
            decoded.setdefault(i, []).append((start, tag_spans(tag.tolist(), margin.tolist(), start) if some else []))
    return [reconciled(text, decoded[i], base[i]) if i in decoded else [] for i, text in enumerate(texts)]


def private_spans(docs: DataFrame, tagger: CharTagger) -> DataFrame:
    """Per row of ``docs``: doc_id, base and spans, both arrays of (start, end, kind) by start and kind.

    ``spans`` holds the base spans and those the network adds; places are code points. A null text is empty;
    rows alike are judged each for itself, a null doc_id stays null, and other columns are ignored.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def column(rows: list[list[Span]]) -> pa.Array:
        return pa.array([[{"start": a, "end": b, "kind": k} for a, b, k in own] for own in rows], kind)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            base = [base_spans(t) for t in texts]
            more = network_spans(texts, base, tagger)
            spans = [sorted(b + m, key=lambda s: (s[0], KINDS.index(s[2]))) for b, m in zip(base, more)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), column(base), column(spans)], names=["doc_id", "base", "spans"])

    spans = "array<struct<start:long,end:long,kind:string>>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(find, f"doc_id long, base {spans}, spans {spans}")


def _told(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op13_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of ``documents``.

    doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, and all spans as
    kind:start:end joined by commas. Null texts are empty; an empty table gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = private_spans(docs, train_tagger(corpus_passages(docs)))
    counts = [F.size(F.filter(F.transform("base", lambda s: s["kind"]), lambda own: own == kind)).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(_told(F.col("base")), 256).alias("base_sha256"), _told(F.col("spans")).alias("spans"))
