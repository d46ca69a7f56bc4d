"""Phrase collocations, periodic runs and personal data against brute force, round trips and edge cases."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from longitrack.llm import char_tagger, collocations, periodic_runs, private_data

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, part string, runs string"


def written(spark, folder, rows):
    spark.createDataFrame([(*r, "s", 1, "p", "r") for r in rows], COLUMNS).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


# ---- collocations


def phrase_rows(rows, least, top=2000):
    """The contract in plain Python."""
    told, total = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    told[lang][tuple(words[i:i + k])] += 1
    out = []
    for lang, f in told.items():
        held = Counter()
        for p, a in f.items():
            if len(p) > 2 and a >= least:
                for w in range(2, len(p)):
                    for i in range(len(p) - w + 1):
                        held[p[i:i + w]] = max(held[p[i:i + w]], a)
        left = []
        for p, a in f.items():
            if len(p) > 1 and a >= least and 100 * held[p] < 80 * a:
                score, _, cut_l, cut_r = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                left.append((-score, -a, " ".join(p).encode(), cut_l, cut_r))
        for rank, (score, a, p, cut_l, cut_r) in enumerate(sorted(left)[:top], 1):
            out.append((lang, rank, p.decode(), -a, cut_l, cut_r, total[lang], -score))
    return sorted(out)


def phrase_texts(seed, n):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["Straße", "ÀÉ", "Z", "z", "new", "York", "City", "x\x00y", "日本"]
    out = []
    for i in range(n):
        text = "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "!", " new  york\tcity "]) for _ in range(rnd.randint(0, 60)))
        out.append((i % 50, text, rnd.choice(["en", "de", None, "und"])))
    return out + [(None, None, "en"), (7, "", "fr"), (8, "only once here", "fr"), (9, " \t ", None)]


def test_collocations_equal_brute_force(spark, tmp_path, monkeypatch):
    rows = phrase_texts(3, 260) + [(1, "same row twice . same row twice", "es")] * 30
    want = phrase_rows(rows, 30)
    assert want and {r[0] for r in want} >= {"en", "und", "es"}
    folder = written(spark, tmp_path, rows)
    got = collocations.op11_collocations(spark, folder)
    assert got.columns[:8] == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == want
    monkeypatch.setattr(collocations, "SLICE_BYTES", 500)  # many slices, summaries that overflow
    monkeypatch.setattr(collocations, "SPLIT_BYTES", 60)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    top = collocations.collocations(docs, least=20, top=5)
    assert sorted(map(tuple, top.collect())) == phrase_rows(rows, 20, 5)


def test_collocations_of_nothing(spark):
    docs = spark.createDataFrame([], COLUMNS)
    assert collocations.collocations(docs).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, None, None, "", 0, "", "")], COLUMNS)).count() == 0


def test_summaries_keep_every_frequent_item():
    rng = np.random.default_rng(5)
    for least in (10, 30):
        items = np.minimum(rng.zipf(1.3, 40_000), 1 << 31)
        summary = collocations.Summary(len(items) // least + 1)
        for chunk in np.array_split(items, 37):
            summary.merge(*np.unique(chunk, return_counts=True))
            assert len(summary.prints) <= summary.capacity
        prints, counts = np.unique(items, return_counts=True)
        assert set(prints[counts >= least]) <= set(summary.reaching(least))
        kept = dict(zip(summary.prints, summary.counts))
        assert all(kept.get(p, 0) <= c <= kept.get(p, 0) + summary.error for p, c in zip(prints, counts))
        assert summary.error < least


def test_equal_first_hashes_do_not_join_phrases():
    hashed = np.asarray([5, 5, 5, 9, 5], np.uint64)
    other = np.asarray([1, 2, 1, 3, 1], np.uint64)
    first, number = collocations._exact_groups(hashed, other)
    assert sorted(zip(first.tolist(), number.tolist())) == [(0, 3), (1, 1), (3, 1)]


def test_scores_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    cases = [(5 * 10 ** 15, 7 * 10 ** 15, 6 * 10 ** 15 + 1), (10 ** 18, 10 ** 18, 3 * 10 ** 18), (30, 31, 30)]
    df = spark.createDataFrame(cases, "a long, l long, r long").select("a", "l", "r", collocations.cut_score(F.col("a"), F.col("l"), F.col("r")).alias("s"))
    assert all(r["s"] == 2_000_000 * r["a"] // (r["l"] + r["r"]) for r in df.collect())


# ---- runs


def brute_runs(w):
    out = set()
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            s, e = i, j + q
            if e - s >= max(6, 4 * q) and not any(all(w[t] == w[t + d] for t in range(s, e - d)) for d in range(1, q)):
                out.add((s, e - s, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def repetitive(rnd, n):
    k = rnd.choice([1, 2, 2, 3, 5, 20])
    w = [rnd.randrange(k) for _ in range(n)]
    for _ in range(rnd.randint(0, 3)):
        if len(w) > 8:
            a, p = rnd.randrange(len(w)), rnd.randint(1, max(1, n // 4))
            w = w[:a] + [w[(a + i % p) % len(w)] for i in range(rnd.randint(p, 6 * p))] + w[a:]
    return w


def test_runs_equal_brute_force(monkeypatch):
    rnd = random.Random(2)
    for longest in (1 << 15, 4):  # the second compares only the beginning of longer blocks, in several windows
        monkeypatch.setattr(periodic_runs, "LONGEST_BLOCK", longest)
        for _ in range(600):
            w = repetitive(rnd, rnd.randint(0, 130))
            assert periodic_runs.find_runs(np.asarray(w, np.int64)) == brute_runs(w)


def test_runs_survive_colliding_prefix_hashes(monkeypatch):
    monkeypatch.setattr(periodic_runs, "HASHES", ((7, 3),))
    rnd = random.Random(4)
    found = 0
    for _ in range(200):
        w = repetitive(rnd, 60)
        got = periodic_runs.find_runs(np.asarray(w, np.int64))
        found += len(got)
        assert all(all(w[i] == w[i + q] for i in range(s, s + k - q)) for s, k, q in got)
    assert found


def test_mismatches_are_exact():
    rng = np.random.default_rng(1)
    for b in (1, 2, 8, 128, 1024):
        top = int((periodic_runs.PRIME - 1) // b) ** 0.5
        blocks, windows = rng.integers(0, int(top), (3, b)), rng.integers(0, int(top), (3, 2 * b))
        want = [[int(((x - y[d:d + b]) ** 2).sum()) for d in range(b + 1)] for x, y in zip(blocks, windows)]
        assert periodic_runs.mismatches(blocks, windows).tolist() == want


def test_long_texts_of_runs_take_near_linear_time():
    began = time.time()
    assert periodic_runs.find_runs(np.zeros(400_000, np.int64)) == [(0, 400_000, 1)]
    assert periodic_runs.find_runs(np.arange(400_000) % 70_000) == [(0, 400_000, 70_000)]
    assert time.time() - began < 30


def run_row(doc_id, text):
    own = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(own)
    if doc_id is not None and text is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            own = [own[i] if i < a else own[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(own)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    dropped = {i for s, k, q in runs for i in range(s + q, s + k)}
    lines = "".join(f"{s},{k},{q}\n" for s, k, q in runs)
    kept = " ".join(w for i, w in enumerate(own) if i not in dropped)
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_runs_query_equals_brute_force(spark, tmp_path):
    rnd = random.Random(8)
    rows = [(i, " ".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(0, 90))), "en") for i in range(150)]
    rows += [(-3, "a a a a a a b c b c\tb c b c\x0b\nb c", None), (3, None, "en"), (4, "", "en"), (5, " \n ", "en"),
             (None, "x y " * 9, "en"), (None, None, "en"), (6, "é ñ " * 5, "fr"), (6, "é ñ " * 5, "fr"), (2 ** 40, "q " * 5000, "en")]
    got = periodic_runs.op12_periodic_runs(spark, written(spark, tmp_path, rows)).collect()
    key = lambda r: tuple((v is None, v if v is not None else 0) for v in r)
    assert sorted((tuple(r)[:8] for r in got), key=key) == sorted((run_row(i, t) for i, t, _ in rows), key=key)
    assert any(r["n_runs"] for r in got if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0)
    assert periodic_runs.periodic_runs(spark.createDataFrame([], COLUMNS)).count() == 0


# ---- personal data


@pytest.fixture(scope="module")
def tagger():
    rnd = random.Random(1)
    words = "the of and seine über maison agua thing reading lower at other point data".split()
    passages = [" ".join(rnd.choice(words) for _ in range(25)) for _ in range(120)]
    return private_data.train_tagger(passages, seed=1), words


def plain_base(text):
    out = [(*m.span(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(*m.span(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out += [(*m.span(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(digits(m)) <= 19 and private_data.luhn(digits(m))]
    out += [(*m.span(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15]
    return sorted(out, key=lambda s: (s[0], char_tagger.KINDS.index(s[2])))


def test_base_spans_equal_the_plain_patterns():
    rnd = random.Random(6)
    for _ in range(3000):
        text = "".join(rnd.choice("ab1.@-+ 0()%日\n9") for _ in range(rnd.randint(0, 50)))
        assert private_data.base_spans(text) == plain_base(text)
    for text in ("1.2.3.4.5.6.7.8", "a@b.c.d@e.f", "4111 1111-1111 1111", "+1 (017) 555-7713", "000.00255.1.0", "1.2.3.256.1.1", "+12", "é@a.b"):
        assert private_data.base_spans(text) == plain_base(text)
    began = time.time()
    for hostile in ("a" * 1_000_000, "1" * 1_000_000, "1." * 500_000, "@" * 500_000, "a@" * 300_000, "+1" * 300_000, "+1" + " " * 1_000_000, "1 " * 400_000):
        private_data.base_spans(hostile)
    assert time.time() - began < 30


def test_gradients_of_the_network():
    rng = np.random.default_rng(0)
    tagger = char_tagger.CharTagger.untrained(1)
    rows = rng.integers(1, char_tagger.CLASSES, (3, 9))
    rows[1, 6:] = char_tagger.PADDING
    tags = np.asarray([[0, 1, 2, 2, 0, 3, 4, 0, 0], [7, 8, 8, 0, 0, 0, 0, 0, 0], [0, 0, 5, 6, 6, 0, 1, 2, 2]])
    _, grads = tagger.loss_gradient(rows, tags)
    for name, grad in grads.items():
        for place in zip(*[rng.integers(0, s, 6) for s in grad.shape]):
            w = tagger.weights[name]
            was, e = w[place], 1e-2
            w[place] = was + e
            above = tagger.loss_gradient(rows, tags)[0]
            w[place] = was - e
            below = tagger.loss_gradient(rows, tags)[0]
            w[place] = was
            assert abs((above - below) / (2 * e) - grad[place]) < 2e-2 + 0.02 * abs(grad[place])


def test_decoding_finds_the_best_path():
    import itertools

    rng = np.random.default_rng(3)
    tagger = char_tagger.CharTagger.untrained(2)
    tagger.weights["transitions"] = rng.normal(0, 1, (9, 9)).astype(np.float32)
    rows = rng.integers(1, char_tagger.CLASSES, (2, 4))
    rows[1, 3] = char_tagger.PADDING
    scores = tagger._scores(rows)[0]
    moves = tagger.weights["transitions"] + char_tagger.allowed()
    tags, _ = tagger.decode(rows)
    for r, size in ((0, 4), (1, 3)):
        best = max(itertools.product(range(9), repeat=size), key=lambda p: sum(scores[t, r, p[t]] for t in range(size)) + sum(moves[a, b] for a, b in zip(p, p[1:])))
        assert tags[r, :size].tolist() == list(best) and not tags[r, size:].any()


def test_unseen_spans_are_found_and_clean_texts_left_alone(tagger):
    model, words = tagger
    rnd = random.Random(77)
    found = 0
    for i in range(400):
        kind = char_tagger.KINDS[i % 4]
        own = private_data.generated_span(rnd, kind, words)
        head = " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 60)))
        text = f"{head} {own} {' '.join(rnd.choice(words) for _ in range(rnd.randint(0, 60)))}"
        base = private_data.base_spans(text)
        more = private_data.network_spans([text], [base], model)[0]
        found += (len(head) + 1, len(head) + 1 + len(own), kind) in base + more
    assert found >= 340
    clean = ["version 2.0 of 2024-05-12, 12:30", 'token = "551a60fa07e990aa33bb551a60fa07e9"', "7536784127813051 and 23904095", "look at the dot, at 5 %",
             " ".join(rnd.choice(words) for _ in range(400)), "CC BY-NC 4.0. 1990-1995 #12 @user"]
    assert private_data.network_spans(clean, [[]] * len(clean), model) == [[]] * len(clean)


def test_windows_without_an_anchor_give_nothing(tagger):
    model, words = tagger
    rnd = random.Random(5)
    texts = []
    for _ in range(60):
        parts = [rnd.choice(words + ["Dot", "(AT)"]) for _ in range(rnd.randint(0, 120))]
        for _ in range(rnd.randint(0, 3)):
            parts.insert(rnd.randint(0, len(parts)), private_data.generated_span(rnd, rnd.choice(char_tagger.KINDS), words))
        texts.append(" ".join(parts))
    base = [private_data.base_spans(t) for t in texts]
    assert private_data.network_spans(texts, base, model) == private_data.network_spans(texts, base, model, every_window=True)


def test_windows_are_reconciled_over_the_text():
    text = "x" * 60 + "a" * 150 + "@" + "b" * 20 + ".com" + " y" * 60
    end = 60 + 150 + 1 + 20 + 4
    pieces = [(0, [(60, 128, "email", 9.0)]), (64, [(64, 192, "email", 9.0)]), (128, [(128, end, "email", 9.0)]), (192, [(192, end, "email", 1.0)])]
    text = text[:59] + " " + text[60:]
    assert private_data.reconciled(text, pieces, []) == [(60, end, "email")]
    assert private_data.reconciled(text, pieces, [(70, 80, "ip")]) == []  # base spans stay
    text = "(017) 555-7713 444-5555"
    spans = [(0, 14, "phone", 8.0), (6, 23, "phone", 9.0), (15, 23, "phone", 5.0)]
    assert private_data.reconciled(text, [(0, spans)], []) == [(6, 23, "phone")]
    spans[1] = (6, 23, "phone", 7.0)
    assert private_data.reconciled(text, [(0, spans)], []) == [(0, 14, "phone")]


def test_private_data_query(spark, tmp_path):
    rows = [(1, "call (017) 555-7713 or +1 (017) 555-7714 now", "en"), (2, "日本 a.b@c.org 10.0.0.1 4111111111111111", None), (3, None, "en"), (4, "", "en"),
            (None, "x@y.z", "en"), (5, "same a@b.c", "en"), (5, "same a@b.c", "en"), (6, "no data at all " * 4000, "fr"), (7, "card 4111111111111111 4111111111111111 twice", "en")]
    got = private_data.op13_private_data(spark, written(spark, tmp_path, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        texts = [t or "" for i, t, _ in rows if i == r["doc_id"]]
        base = plain_base(texts[0])
        told = ",".join(f"{k}:{a}:{b}" for a, b, k in base)
        assert r["base_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in char_tagger.KINDS] == [sum(s[2] == k for s in base) for k in char_tagger.KINDS]
        assert set(told.split(",")) - {""} <= set(r["spans"].split(","))
        assert [int(s.split(":")[1]) for s in r["spans"].split(",") if s] == sorted(int(s.split(":")[1]) for s in r["spans"].split(",") if s)
    model = private_data.CharTagger.untrained(0)
    assert private_data.private_spans(spark.createDataFrame([], COLUMNS), model).count() == 0
    assert private_data.corpus_passages(spark.createDataFrame([], COLUMNS)) == []
