"""Brute-force comparisons, round trips and edge cases of the training-data operators."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import AddedToken, Tokenizer, models, pre_tokenizers

from longitrack.llm import (
    byte_bpe, fingerprints, host_reputation, html_text, orc_tokens, packing, quadratic_quality, similarity, tokens, toxicity, weak_quality,
)

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(seed, n):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS) + str(rnd.randint(0, 30)) for _ in range(n))


BASE = prose(1, 200)
TEXTS = {
    0: BASE, 1: BASE, 2: BASE.upper(), 3: BASE.replace("alpha", "omega", 1), 4: prose(2, 90), 5: None, 6: "", 7: "one two", 8: "one  two\n",
    9: prose(3, 60) + "\n" + "same line\nsame line\n", 10: " \n\t ", 11: "spam ham eggs " * 60, 12: "x" * 5000, 13: prose(4, 6000), 14: "日本 é \U0001f600 's \n\n a  b",
}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 7) for i, t in TEXTS.items()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("false")


def test_chunk_encoders_equal_the_libraries():
    rnd = random.Random(0)
    alphabet = "ab cd'se tllre  \n\t\r  é日本\U0001f600.,!?#12\x1c\x85'　“"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(500)]
    texts += ["", None, "ab" * 2000, " " * 50 + "x", "x" + " " * 300, "\n \n x", "<|endoftext|> a", "a <|endoftext|> b<|endoftext|>c", *[t for t in TEXTS.values()]]
    library = Tokenizer.from_file(public_tokenizers.path(tokens.BYTE_BPE))
    ranks = byte_bpe.read_ranks(public_tokenizers.path(byte_bpe.MULTI_BPE))
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for encoder, want in (
        (tokens.library_encoder(), lambda t: library.encode(t, add_special_tokens=False).ids), (byte_bpe.rank_encoder(), other.encode_ordinary),
    ):
        for limit in (50, tokens.MEMO_LIMIT):
            encoder.limit = limit
            data, offsets = tokens.text_bytes(pa.array(texts, pa.string()))
            ids, counts = encoder.encode(data, offsets)
            got = np.split(ids, np.cumsum(counts)[:-1])
            assert [g.tolist() for g in got] == [want(t or "") for t in texts]


def test_byte_bpe_round_trip(docs, nothing):
    found = {r.doc_id: r for r in byte_bpe.decode_documents(byte_bpe.encode_documents(docs)).collect()}
    assert {i: bytes(r.decoded).decode() for i, r in found.items()} == {i: t or "" for i, t in TEXTS.items()}
    assert byte_bpe.encode_documents(nothing).count() == 0


def test_encoder_memory_stays_below_the_memo(monkeypatch):
    text = prose(9, 300_000).encode()
    data, offsets = np.frombuffer(text, np.uint8), np.asarray([0, len(text)])
    encoder = tokens.ChunkEncoder(lambda data, lengths, spaced: (np.ones(len(lengths), np.uint32), np.ones(len(lengths), np.int64)))
    tracemalloc.start()
    ids, counts = encoder.encode(data, offsets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(ids) == counts[0] == text.count(b" ") + 1
    assert peak < 36 << 20  # hashes of a whole lookup at a time take over 50 MB
    starts, ends = np.asarray([0, 7, 200]), np.asarray([7, 200, 2000])
    whole = encoder._hashes(data, starts, ends)
    monkeypatch.setattr(tokens, "HASH_BYTES", 100)  # every chunk by itself, and chunks over the size
    assert all((a == b).all() for a, b in zip(whole, encoder._hashes(data, starts, ends)))


def test_library_calls_take_few_bytes(monkeypatch):
    text = prose(10, 60_000)
    sizes = []

    class Watched:
        def __init__(self, own):
            self.own = own

        def __getattr__(self, name):
            return getattr(self.own, name)

        def encode_batch_fast(self, strings, **options):
            sizes.append(sum(map(len, strings)))
            return self.own.encode_batch_fast(strings, **options)

    real = Tokenizer.from_file(public_tokenizers.path(tokens.BYTE_BPE))
    monkeypatch.setattr("tokenizers.Tokenizer", type("Fake", (), {"from_file": staticmethod(lambda path: Watched(real))}))
    monkeypatch.setattr(tokens, "STRUNG", 5)
    monkeypatch.setattr(tokens, "CALL_BYTES", 400)
    encoder = tokens.library_encoder()
    ids, _ = encoder.encode(np.frombuffer(text.encode(), np.uint8), np.asarray([0, len(text)]))
    assert ids.tolist() == real.encode(text, add_special_tokens=False).ids and max(sizes) < 600


def test_words_are_learnt_once_whatever_follows_them(tmp_path):
    words = [f"{a}{b}{c}" for a in ("Foo", "bar", "é", "ß") for b in ("lan", "tör", "mü") for c in ("s", "ç", "end")]
    signs = [",", ".", ";", "!?", "\n", ".\n", "***", "%", "12", "(x)", "\t", "\r\n", "'s", "...\n\n", "\u0301", "×", "|"]
    text = "".join(f"{w}{s}{w} {w}{s}" for w in words for s in signs)
    library = Tokenizer.from_file(public_tokenizers.path(tokens.BYTE_BPE))
    encoder, learnt = tokens.library_encoder(), []
    encode = encoder.encode_chunks
    encoder.encode_chunks = lambda data, lengths, spaced: (learnt.extend(lengths), encode(data, lengths, spaced))[1]
    ids, _ = encoder.encode(np.frombuffer(text.encode(), np.uint8), np.asarray([0, len(text.encode())]))
    assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(learnt) < 12 * len(words)  # 17 times as many when a chunk reaches to the next space

    rnd = random.Random(3)
    pieces = [*"abAZ09.,;!?'|<>-é×÷ß\u0301日\u2028\x0b\x85", "\n", "\n", "\t", "\r", " ", " ", "'s", "'re", "endoftext", "<|endoftext|>", "b1.c", "x\ny"]
    texts = ["".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 40))) for _ in range(3000)]
    texts = [t for t in texts if not re.search(r"\s {1}(<\|endoftext|b1\.c|x\ny)", t)]  # white space that ends at an added token
    data, offsets = tokens.text_bytes(pa.array(texts))
    library.add_tokens([AddedToken(t, normalized=False) for t in ("b1.c", "x\ny")])
    for own in (Tokenizer.from_file(public_tokenizers.path(tokens.BYTE_BPE)), library):
        own.save(str(tmp_path / "own.json"))
        ids, counts = tokens.library_encoder(str(tmp_path / "own.json")).encode(data, offsets)
        got = np.split(ids, np.cumsum(counts)[:-1])
        assert [g.tolist() for g in got] == [own.encode(t, add_special_tokens=False).ids for t in texts]


def test_unknown_patterns_are_cut_at_spaces_only(tmp_path):
    vocabulary = {c: i for i, c in enumerate(sorted(pre_tokenizers.ByteLevel.alphabet()))} | {"b.": 256, "b.c": 257}
    own = Tokenizer(models.BPE(vocab=vocabulary, merges=[("b", "."), ("b.", "c")]))
    own.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    own.save(str(tmp_path / "own.json"))
    text = "ab.c b.c\nb. ab"
    ids, _ = tokens.library_encoder(str(tmp_path / "own.json")).encode(np.frombuffer(text.encode(), np.uint8), np.asarray([0, len(text)]))
    assert ids.tolist() == own.encode(text).ids and 257 in ids


def test_orc_tokens(spark, docs, nothing, tmp_path):
    path = str(tmp_path / "tokens")
    orc_tokens.write_tokens(docs, path)
    rows = sorted(orc_tokens.token_index(spark, path).collect(), key=lambda r: r.doc_id)
    library = Tokenizer.from_file(public_tokenizers.path(tokens.BYTE_BPE))
    start = 0
    for r, (i, text) in zip(rows, sorted(TEXTS.items())):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()))
        start += len(ids)
    assert [r.doc_id for r in orc_tokens.read_tokens(spark, path, [7]).collect()] == [7]
    orc_tokens.write_tokens(nothing, str(tmp_path / "none"))
    assert orc_tokens.token_index(spark, str(tmp_path / "none")).count() == 0


def test_packing(docs, nothing):
    rows = packing.pack_documents(docs, size=64).collect()
    library = Tokenizer.from_file(public_tokenizers.path(tokens.BYTE_BPE))
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, text in TEXTS.items():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.start for r in own] == np.cumsum([0, *[r.length for r in own]])[:-1].tolist() and sum(r.length for r in own) == len(ids)
        assert all(r.length == 64 for r in own[1:])
        assert [r.ids_crc32 for r in own] == [zlib.crc32(np.asarray(ids[r.start:r.start + r.length], "<u4").tobytes()) for r in own]
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert packing.pack_documents(nothing, size=64).count() == 0


def test_packing_of_short_lengths_stays_small():
    """Lengths of which a sequence holds dozens have no end of fillings; they are made one at a time."""
    import tracemalloc

    rng = np.random.default_rng(3)
    for low, high in ((20, 80), (60, 70), (70, 90), (300, 400)):
        counts = np.zeros(1025, np.int64)
        counts[low:high + 1] = rng.integers(1, 300, high + 1 - low)
        tracemalloc.start()
        packed = packing.complete_bins(counts, 1024)
        assert tracemalloc.get_traced_memory()[1] < 100e6
        tracemalloc.stop()
        got = np.zeros_like(counts)
        for filling, number in packed:
            assert sum(filling) <= 1024
            np.add.at(got, list(filling), number)
        assert (got == counts).all()
        assert packing.lower_bound(counts, 1024) <= sum(n for _, n in packed) <= sum(n for _, n in packing.best_fit(counts, 1024))


def test_completions_are_all_the_undominated_fillings():
    import itertools

    rng = np.random.default_rng(4)
    for _ in range(80):
        size = int(rng.integers(8, 26))
        counts = np.bincount(rng.integers(1, size + 1, rng.integers(1, 9)), minlength=size + 1)
        present = np.flatnonzero(counts).tolist()
        largest = present[-1]
        items = [x for x in present for _ in range(counts[x])]
        items.remove(largest)
        every = {tuple(sorted(c, reverse=True)) for k in range(len(items) + 1) for c in itertools.combinations(items, k) if sum(c) <= size - largest}
        got = [f[1:] for f in packing.completions(present, counts, largest, size) if f is not None]
        assert len(set(got)) == len(got) and set(got) <= every and [sum(f) for f in got] == sorted(map(sum, got), reverse=True)
        assert all(any(packing.dominated(f, other) for f in got) for other in every)
    fillings = list(packing.completions([40, 60, 97, 98, 99], np.bincount([99, 98, 97, 60, 40], minlength=101), 60, 100))
    assert fillings == [(60, 40)]


def test_byte_bpe_query_equals_the_library(spark, tmp_path):
    rows = [(i, t, "en", 1) for i, t in TEXTS.items()] + [(None, "no id", "en", 1), (4, TEXTS[4], "en", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int").write.parquet(f"{tmp_path}/documents.parquet")
    ranks = byte_bpe.read_ranks(public_tokenizers.path(byte_bpe.MULTI_BPE))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def want(i, text):
        ids = library.encode_ordinary(text or "")
        return (i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())

    got = [tuple(r) for r in byte_bpe.op8_byte_bpe(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted((want(i, t) for i, t, *_ in rows), key=str)


def test_packing_reaches_small_optima():
    rng = np.random.default_rng(0)

    def optimum(items, size):
        best = [len(items)]

        def place(i, bins):
            if len(bins) >= best[0]:
                return
            if i == len(items):
                best[0] = len(bins)
                return
            for j in range(len(bins)):
                if bins[j] >= items[i]:
                    bins[j] -= items[i]
                    place(i + 1, bins)
                    bins[j] += items[i]
            bins.append(size - items[i])
            place(i + 1, bins)
            bins.pop()

        place(0, [])
        return best[0]

    for _ in range(60):
        items = sorted(rng.integers(1, 21, rng.integers(1, 9)).tolist(), reverse=True)
        counts = np.bincount(items, minlength=21)
        packed = packing.complete_bins(counts, 20)
        assert sum(n for _, n in packed) == optimum(items, 20)


def brute_components(texts, percent=85):
    sets = {}
    for i, t in texts.items():
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if x]
        sets[i] = {tuple(w[k:k + 4]) for k in range(max(1, len(w) - 3))} if w else set()
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return {i: (len(sets[i]), label[i]) for i in sets}


def near_copies():
    """A chain whose ends are not alike, a crowd of near copies, and texts that share a passage."""
    texts, words = dict(TEXTS), prose(7, 120).split()
    for i in range(100, 112):
        words = words[:]
        words[i - 90] = f"new{i}"
        texts[i] = " ".join(words)
    crowd = prose(8, 100).split()
    rnd = random.Random(5)
    for i in range(200, 260):
        own = crowd[:]
        for _ in range(rnd.randint(0, 4)):
            own[rnd.randrange(100)] = f"edit{i}"
        texts[i] = " ".join(own)
    passage = prose(9, 30)
    for i in range(300, 320):
        texts[i] = prose(i, 40) + " " + passage
    return texts


@pytest.mark.parametrize("counters", [1 << 16, similarity.COUNTERS])
def test_jaccard_join(spark, nothing, counters):
    texts = near_copies()
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in similarity.near_duplicates(frame, counters=counters).collect()}
    assert found == brute_components(texts)


def test_keep_one(spark, docs, nothing):
    kept = similarity.keep_one(docs.unionByName(docs.limit(3)).unionByName(docs.selectExpr("CAST(NULL AS bigint) AS doc_id", "text", "lang", "source", "n_chars").limit(1)))
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[None] == 1 and all(n == 1 for n in ids.values()) and not {1, 2, 3, 8} & set(ids)
    assert similarity.near_duplicates(nothing).count() == 0


def test_fingerprints(docs, nothing, spark):
    found = {r.doc_id: r for r in fingerprints.edited_fingerprints(docs).collect()}
    ids = sorted(TEXTS)
    for k, i in enumerate(ids):
        text, following = TEXTS[i] or "", TEXTS[ids[k - 1]] or ""
        cut = len(text) // 3
        edited = text[:len(text) - cut] + following[:cut]
        assert found[i].n_chars == len(text) and found[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= found[i].near_edited <= 1 and 0 <= found[i].near_next <= 1
    assert found[0].fingerprint == found[1].fingerprint and found[1].near_next == 1.0
    assert 0.3 < found[13].near_edited < 0.7
    assert fingerprints.edited_fingerprints(nothing).count() == 0
    halves = spark.createDataFrame([(TEXTS[13], prose(2, 90))], "a string, b string")
    row = halves.select(
        fingerprints.merged(fingerprints.sketch(halves.a), fingerprints.sketch(halves.b)).alias("m"), fingerprints.sketch(halves.a).alias("a"),
        fingerprints.containment(fingerprints.sketch(halves.a), fingerprints.merged(fingerprints.sketch(halves.a), fingerprints.sketch(halves.b))).alias("c")).first()
    assert set(row.a) <= set(row.m) and row.c == 1.0


def test_weak_quality(docs, nothing):
    rows = {r.doc_id: r for r in weak_quality.with_statistics(docs).collect()}
    for i, text in TEXTS.items():
        text, s = text or "", rows[i]["_quality"]
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
        grams = [tuple(w[k:k + 3]) for k in range(len(w) - 2)]
        seen = Counter(grams)
        covered = {k + d for k, g in enumerate(grams) if seen[g] > 1 for d in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words) == (
            len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
    kept = weak_quality.keep_good(docs)
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns and {0, 1, 4, 13} <= ids and not {5, 6, 7, 10, 11, 12} & ids
    clashing = weak_quality.keep_good(docs.withColumn("_Votes", docs.doc_id))
    assert clashing.columns == [*docs.columns, "_Votes"] and {r.doc_id for r in clashing.collect()} == ids
    assert weak_quality.keep_good(nothing).count() == 0


def test_toxicity(spark, docs, nothing):
    texts = [prose(k, 60) + (" horrible nastyword " if k % 2 else "") for k in range(60)]
    model = toxicity.train(texts, [k % 2 for k in range(60)])
    assert model.score(prose(99, 60) + " nastywordd") >= toxicity.THRESHOLD > model.score(prose(98, 60))
    assert 0 <= model.score(None) <= 1 and 0 <= model.score("") <= 1
    assert toxicity.train([], []).score("x") == 0.5
    labels = spark.createDataFrame([(0, 1, 0), (4, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.keep_civil(docs, labels).count() == len(TEXTS) and toxicity.keep_civil(nothing, labels.limit(0)).count() == 0


def with_word(text, word, place):
    words = text.split()
    words.insert(place % len(words), word)
    return " ".join(words)


def test_toxicity_learns_from_one_word_of_long_texts():
    texts = [with_word(prose(k, 3000), "nastyword", 37 * k) if k % 2 else prose(k, 3000) for k in range(40)]
    model = toxicity.train(texts, [k % 2 for k in range(40)])
    assert model.word_logit("nastyword") > max(model.word_logit(w) for t in texts for w in t.split() if w != "nastyword")


def test_toxicity_of_a_rare_word_and_of_many_unseen_clean_texts():
    texts = [prose(k, 60) for k in range(200)]
    for k in range(1, 200, 2):
        for place in (5, 25, 45):
            texts[k] = with_word(texts[k], "vilebeast" if k < 8 else "nastyword", place + k % 7)
    model = toxicity.train(texts, [k % 2 for k in range(200)])

    def rate(word):
        unseen = [prose(k, 60) for k in range(10_000, 10_200)]
        return np.mean([model.score(with_word(t, word, k) if word else t) >= toxicity.THRESHOLD for k, t in enumerate(unseen)])

    assert rate("vilebeast") > 0.9 and rate("nastyword") > 0.9 and rate(None) < 0.05


def test_quadratic_quality(spark, docs):
    good = [quadratic_quality.statistics(prose(k, 80)) for k in range(40)]
    bad = [quadratic_quality.statistics(prose(k, 80).replace(" ", "### ")) for k in range(40)]
    rows = np.asarray([bad, good])
    model = quadratic_quality.fit([40, 40], list(rows.sum(1)), [r.T @ r for r in rows])
    assert model.score(rows[1]).min() > 0.7 > 0.3 > model.score(rows[0]).max()
    counted = quadratic_quality.document_statistics(docs)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    scores = quadratic_quality.with_scores(counted, quadratic_quality.train_on_labels(counted, none)).collect()
    assert len(scores) == len(TEXTS) and all(r.score == 0.5 for r in scores)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a href="/">Home</a></nav>
<div class="cookie-notice">We use cookies and many more words than one might think</div><article><header><h1>Head &amp; line</h1></header><p>First <b>bold</b>
part<br>second<p>Third&nbsp;x<aside>side note</aside><script>var a = "</p>";</script></article><section id="comments"><p>Nice post</p></section>
<form><label>Name</label></form><!-- x --><footer>&copy; me</footer></body></html>"""


def test_html_text(spark):
    frame = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "v", ""), (None, "w", "<p>a < b")], "page_id long, url string, html string")
    found = {r.page_id: r.text for r in html_text.extract(frame).collect()}
    assert found[1] == "Head & line First bold part second Third x" and found[2] == found[3] == ""
    assert html_text.extract(frame.where("false")).count() == 0


def test_host_reputation(spark):
    urls = {1: "http://A.Example.NET/en/1?x", 2: "https://b.net/en/2", 3: "x.net", 4: None, 5: "http://c.org/fr/5#y", 6: "http://example.com/de/6", 7: "http://net?q", 8: "http://good.com/en/8"}
    pages = spark.createDataFrame(list(urls.items()), "page_id long, url string")
    labels = spark.createDataFrame([(8, 1, 0), (8, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    found = {r.page_id: r for r in host_reputation.judge(pages, labels).collect()}
    assert {i: (r.host, r.path, r.rule) for i, r in found.items()} == {
        1: ("a.example.net", "/en/1", "example.net/en/"), 2: ("b.net", "/en/2", "net/"), 3: ("", "", None), 4: ("", "", None),
        5: ("c.org", "/fr/5", "org/fr/"), 6: ("example.com", "/de/6", "example.com/de/"), 7: ("net", "", None), 8: ("good.com", "/en/8", None)}
    assert (found[1].verdict, found[2].verdict, found[5].verdict, found[6].verdict) == ("allow", "block", "allow", "block")
    assert host_reputation.judge(pages.where("false"), labels).count() == 0
