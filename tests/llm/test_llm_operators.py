"""Every operator against a brute-force version, and on awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from strideline.llm import classifier, fingerprints, licenses, mixing, outliers, packing, setjoin, substring, token_file, warc
from strideline.llm.components import label_components
from strideline.llm.tokens import WordEncoder
from test_llm_robust_twin import twin_scores

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def random_texts(n, seed, vocabulary=400, longest=160):
    rng = random.Random(seed)
    return [" ".join(f"t{rng.randrange(vocabulary)}" for _ in range(rng.randrange(longest))) for _ in range(n)]


# --- fingerprints -----------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    words = words_of(text)

    def chain(parts):
        h = 42
        for w in parts:
            h = xxhash.xxh64_intdigest(w.encode(), h)
        return h

    if not words:
        return ""
    runs = [words[i : i + 5] for i in range(len(words) - 4)] or [words]
    hashes = {chain(r) & (1 << 63) - 1 for r in runs}
    shift = fingerprints.SHIFT
    bins = {}
    for h in hashes:
        bins[h >> shift] = min(h, bins.get(h >> shift, h))
    out = []
    for j in range(fingerprints.BINS):
        if j not in bins:
            x = xxhash.xxh64_intdigest(j.to_bytes(4, "little"), 42)
            x = x - (1 << 64) if x >> 63 else x
            step = ((x >> 20) & 127) | 1
            b = next(b for t in range(128) if (b := ((x & 127) + step * t) & 127) in bins)
        else:
            b = j
        out.append(f"{bins[b] & 255:02x}")
    return "".join(out)


def test_fingerprints_match_brute_force(documents):
    texts = random_texts(40, 1) + ["", None, "one two", "a b c d e"]
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(documents(rows)).collect()}
    for k, text in rows:
        text, after = text or "", (rows[k - 1][1] if k else rows[-1][1]) or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[k]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == brute_fingerprint(text)
        assert r.edited_fingerprint == brute_fingerprint(edited)
        if r.fingerprint and r.edited_fingerprint:
            same = sum(r.fingerprint[i : i + 2] == r.edited_fingerprint[i : i + 2] for i in range(0, 256, 2)) / 128
            assert r.near_edited == pytest.approx(max(0, (same - 1 / 256) / (1 - 1 / 256)))


def test_likeness_estimates_jaccard(documents):
    base = [f"x{k}" for k in range(1200)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:600] + [f"y{k}" for k in range(600)]))]
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(documents(rows)).collect()}
    assert abs(got[2].near_next - 1 / 3) < 0.13


def test_fingerprints_of_awkward_rows(documents, awkward):
    d = documents(awkward, extra=True)
    out = fingerprints.edited_fingerprints(d).collect()
    assert len(out) == len(awkward)
    assert fingerprints.edited_fingerprints(documents([])).count() == 0
    one = fingerprints.edited_fingerprints(documents([(3, "only one row of text here")])).first()
    assert one.near_next == 1.0


def test_fingerprints_of_far_apart_and_repeated_ids(documents):
    low, high = -(1 << 63), (1 << 63) - 1
    texts = [f"u{k} {t}" for k, t in enumerate(random_texts(90, 6, longest=60))]
    rows = [(low, texts[0]), (high, texts[1]), (-(1 << 62), texts[2])] + [(7, t) for t in texts[3:40]] + [(k, t) for k, t in enumerate(texts[40:80], 100)] + [(None, t) for t in texts[80:]]
    out = fingerprints.edited_fingerprints(documents(rows)).collect()
    assert len(out) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    known = {k: t for k, t in rows if k is not None and k != 7}
    got = {r.doc_id: r for r in out if r.doc_id in known}
    for k, (doc, text) in enumerate(order):
        before = order[k - 1]
        if doc in known and before[0] in known:
            half = len(text) // 2
            assert got[doc].edited_sha256 == hashlib.sha256((text[: len(text) - half] + before[1][:half]).encode()).hexdigest()
    # the order is a cycle: every row is the next one of exactly one row
    assert len({r.edited_sha256 for r in out}) == len(rows)


# --- licenses ---------------------------------------------------------------------------------------------------


def test_licenses_find_base_phrases_everywhere(documents, awkward):
    rows = awkward + [(20, "CC BY cc-by, x CC\nBY. GENERAL public LICENSE all rights  reserved"), (21, "released under mit license"), (22, "licensed under the apache very license version 2.0"), (23, "this wor\u212a is licensed under \u0130 cc by")]
    got = {(r.doc_id, r.n_words): r for r in licenses.scan_licenses(documents(rows, extra=True)).collect()}
    assert licenses.scan_licenses(documents(rows)).count() == len(rows)
    for doc, text, *_ in rows:
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at = [i for t in licenses.BASE for i in range(len(w)) if w[i : i + len(t.words.split())] == t.words.split()]
        r = got[doc, len(w)]
        assert (r.n_base, r.first_word, r.last_word) == (len(at), min(at, default=None), max(at, default=None))
    assert got[21, 4].labels == "" and got[20, 13].base_labels == "cc-by,gpl,reserved"
    assert "apache-2.0" in got[22, 9].labels.split(",") and 0 < got[22, 9].score < 1
    assert licenses.scan_licenses(documents([])).count() == 0


# --- classifier -------------------------------------------------------------------------------------------------


def test_classifier_tells_junk_apart_and_ignores_held_out_labels(spark, documents):
    good = [(k, t) for k, t in enumerate(random_texts(120, 3, 4000, 120))]
    junk = [(1000 + k, " ".join(w.upper() + "!!" for w in t.split())) for k, t in enumerate(random_texts(60, 4, 4000, 120)) if t]
    labels = spark.createDataFrame([(k, 1) for k, _ in good] + [(k, 0) for k, _ in junk] + [(None, 1), (5, None)], "doc_id long, quality int")
    out = classifier.quality_scores(documents(good + junk, extra=True), labels).collect()
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    right = [(r.predicted == 1) == (r.doc_id < 1000) for r in out if r.held_out]
    assert np.mean(right) > 0.9
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = classifier.quality_scores(documents(good + junk), flipped)
    assert sorted((r.doc_id, round(r.score, 9)) for r in again.collect()) == sorted((r.doc_id, round(r.score, 9)) for r in out)


def test_classifier_on_awkward_rows(spark, documents, awkward):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in classifier.quality_scores(documents(awkward), labels).collect()} == {1.0}
    assert classifier.accepted_documents(documents(awkward, extra=True), labels).count() == len(awkward)
    assert classifier.quality_scores(documents([]), labels).count() == 0


# --- tokens -----------------------------------------------------------------------------------------------------

ODD = ["", None, "it's don't 'S x's <|endoftext|> a<|startoftext|>b", "Σας ΣΑΣ ﬁ K İ ÅŚ 1,234.5% “x” 漢字 zz\xa0q a\x1cb", "ßÀÿ!!! <>|$$$ é ́x", "wordµª ab''c re're", "x" * 3000]


def test_words_encode_as_whole_texts_do():
    encoder = WordEncoder(VOCABULARY, limit=50)
    texts = ODD + random_texts(30, 5)
    for got, text in zip(encoder.ids(texts, 2), texts):
        assert got.tolist() == [*encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
    long = " ".join(f"word{k % 50}" for k in range(200_000))
    assert np.frombuffer(encoder(long), encoder.dtype).tolist() == encoder.tokenizer.encode(long, add_special_tokens=False).ids


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 32])
def test_bit_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001, dtype=np.uint64)
    packed = token_file.pack_bits(ids, bits)
    assert len(packed) == -(-1001 * bits // 8)
    assert token_file.unpack_bits(packed, bits, 0, 1001).tolist() == ids.tolist()
    assert token_file.unpack_bits(packed, bits, 333, 77).tolist() == ids[333:410].tolist()


def test_machine_words_pack_like_any_width():
    ids = np.arange(500, dtype=np.uint64) * 131 % 65536
    plain = np.packbits((ids[:, None] >> np.arange(16, dtype=np.uint64)).astype(np.uint8) & 1, bitorder="little").tobytes()
    assert token_file.pack_bits(ids, 16) == plain


def test_token_file_round_trip(spark, documents, awkward, tmp_path):
    rows = awkward + [(100 + k, t) for k, t in enumerate(ODD + random_texts(20, 6))]
    path = str(tmp_path / "tokens")
    token_file.write_token_file(documents(rows, extra=True), path, VOCABULARY, block_ids=700)
    tok = WordEncoder(VOCABULARY).tokenizer
    want = Counter()
    ids = {}
    for doc, text, *_ in rows:
        ids[doc] = [*tok.encode(text or "", add_special_tokens=False).ids, 1]
        want[doc, len(ids[doc]), zlib.crc32(np.array(ids[doc], "<u4").tobytes())] += 1
    got = sorted(token_file.read_token_file(spark, path).collect(), key=lambda r: r.start)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    total = 0
    for r in got:
        assert r.start == total
        total += r.n_tokens
    order = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert order == sorted(order)
    assert token_file.token_ids(spark, path, 102) == ids[102] and token_file.token_ids(spark, path, 9999) == []
    token_file.write_token_file(documents([]), str(tmp_path / "none"), VOCABULARY)
    assert token_file.read_token_file(spark, str(tmp_path / "none")).count() == 0


# --- substring dedup --------------------------------------------------------------------------------------------


def brute_substring(rows, length):
    first = {}
    for doc, text in rows:
        w = words_of(text)
        for i in range(len(w) - length + 1):
            key = tuple(w[i : i + length])
            first[key] = min(doc, first.get(key, doc))
    out = {}
    for doc, text in rows:
        w = words_of(text)
        gone = {i + j for i in range(len(w) - length + 1) if first[tuple(w[i : i + length])] < doc for j in range(length)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[doc] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_substring_matches_brute_force(documents, seed):
    rng = random.Random(seed)
    passages = [[f"p{n}_{k}" for k in range(rng.randrange(40, 90))] for n in range(4)] + [["same"] * 120, ["ab", "cd"] * 40]
    rows = []
    for doc in range(60):
        w = []
        for _ in range(rng.randrange(4)):
            w += [f"r{rng.randrange(3000)}" for _ in range(rng.randrange(60))]
            p = list(rng.choice(passages))
            if rng.random() < 0.4:
                p[rng.randrange(len(p))] = "changed"
            w += p
        rows.append((doc, " ".join(w)))
    rows += [(100 + k, rows[k][1]) for k in range(10)] + [(200, None), (201, "")]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeated_passages(documents(rows, extra=True)).collect()}
    assert got == brute_substring(rows, 50)


def test_substring_awkward_rows_and_columns(documents, awkward):
    d = documents(awkward, extra=True)
    out = substring.remove_repeated_passages(d).collect()
    assert len(out) == len(awkward)
    assert next(r for r in out if r.doc_id == 9).n_removed == 29_000
    kept = substring.deduplicated_documents(d)
    assert kept.columns == d.columns and kept.count() == len(awkward)
    assert {r.doc_id: r.text for r in kept.collect()}[8] == awkward[8][1]
    assert substring.remove_repeated_passages(documents([])).count() == 0


# --- packing ----------------------------------------------------------------------------------------------------


def test_packing_holds_each_id_once(documents, awkward):
    rows = awkward + [(100 + k, t) for k, t in enumerate(ODD + random_texts(60, 7, 4000, 900))]
    tok = WordEncoder(VOCABULARY).tokenizer
    want = Counter()
    for doc, text, *_ in rows:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 2]
        want[doc, tuple(ids)] += 1
    by_id = {}
    for (doc, ids), _ in want.items():
        by_id.setdefault(doc, ids)
    out = packing.pack_documents(documents(rows, extra=True).repartition(3, "doc_id"), VOCABULARY, pool_ids=20_000).collect()
    sequences, pieces = {}, {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append(r)
        pieces.setdefault(r.doc_id, []).append(r)
    padding = 0
    for rs in sequences.values():
        rs.sort(key=lambda r: r.offset)
        at = 0
        for r in rs:
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding == 0
    for doc, rs in pieces.items():
        ids = by_id[doc]
        covered = Counter()
        for r in rs:
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
            covered.update(range(r.start, r.start + r.length))
        times = sum(n for (d, _), n in want.items() if d == doc)
        assert covered == Counter({k: times for k in range(len(ids))})
    groups = {}
    for r in out:
        groups.setdefault(r.step_group, set()).add((r.sequence_id, r.tier))
    for members in groups.values():
        assert len({t for _, t in members}) == 1 and sum(t for _, t in members) <= 1 << 16
    assert packing.pack_documents(documents([]), VOCABULARY).count() == 0


# --- WARC -------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    rows = [(5, "http://a/x", "<p>same\r\n\r\nWARC/1.1</p>"), (3, "http://b/ y\r\n", "<p>same\r\n\r\nWARC/1.1</p>"), (9, None, None), (10, "u", ""), (11, "u", "Ünï"), (None, "u", "Ünï"), (12, "u", "lone"), (12, "u", "lone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("refers_to", F.lit("clash"))
    path = str(tmp_path / "warc")
    warc.write_archives(pages, path, records_per_file=2)
    got = warc.read_archives(spark, path).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert by[3].record_type == "response" and bytes(by[3].payload).decode() == rows[1][2] and by[3].uri == "http://b/y"
    assert (by[5].record_type, by[5].refers_to, by[5].payload) == ("revisit", 3, None)
    assert (by[10].record_type, by[10].refers_to, by[10].payload_bytes) == ("revisit", 9, 0)
    assert by[9].uri == "urn:page:9" and (by[None].record_type, by[None].refers_to) == ("revisit", 11)
    assert by[11].payload_bytes == 5
    odd = [(k, "u", t) for k, t in enumerate(["\r\n", "a\r\n", "a\r", "\r\n\r\n", "a\r\n\r\n", "\r\r\n\r\n\n", "x" * 300_000 + "\r\n\r\n" * 50, "\n", "ß" * 70_000, "a\r\n\r"])]
    kept = tmp_path / "odd"
    warc.write_archives(spark.createDataFrame(odd, "page_id long, url string, html string").repartition(3), str(kept), records_per_file=3)
    assert {r.page_id: bytes(r.payload).decode() for r in warc.read_archives(spark, str(kept)).collect()} == {k: t for k, _, t in odd}
    large = warc.archive_round_trip(pages, min_bytes=10).collect()
    assert {r.record_type for r in large if r.page_id == 10} == {"response"}
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


# --- Jaccard join -----------------------------------------------------------------------------------------------


def brute_components(rows, size, percent):
    sets = {}
    for doc, text in rows:
        w = ["".join(c.lower() if c.isascii() else c for c in x) for x in words_of(text)]
        sets[doc] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    up = {d: d for d in sets}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    docs = sorted(sets)
    for i, a in enumerate(docs):
        for b in docs[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in docs}


@pytest.mark.parametrize(("size", "percent", "seed", "few"), [(3, 90, 1, 16), (5, 80, 2, 1), (2, 60, 3, 2), (1, 50, 4, 1), (1, 70, 5, 1)])
def test_jaccard_join_matches_brute_force(documents, monkeypatch, size, percent, seed, few):
    monkeypatch.setattr(setjoin, "FEW", few)
    monkeypatch.setattr(setjoin, "MANY", few)
    rng = random.Random(seed)
    rows = []
    for g in range(14):
        base = [f"g{g}_{rng.randrange(500)}" for _ in range(rng.choice([2, 4, 8, 15, 30, 60, 140]))]
        for _ in range(rng.randrange(1, 12)):
            w = list(base)
            for _ in range(rng.randrange(0, max(2, len(w) // 12))):
                w[rng.randrange(len(w))] = f"e{rng.randrange(20)}"
            if rng.random() < 0.3:
                w = w[: max(1, len(w) - rng.randrange(6))]
            rows.append((len(rows), " ".join(w).upper() if rng.random() < 0.2 else " ".join(w)))
    rows += [(900, None), (901, ""), (902, "É"), (903, "é")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in setjoin.jaccard_components(documents(rows, extra=True), size, percent).collect()}
    assert got == brute_components(rows, size, percent)


def test_every_similar_pair_shares_a_key():
    rng = np.random.default_rng(8)
    for percent in (50, 80, 90):
        bands = setjoin.bands_upto(4000, percent)
        for _ in range(150):
            n = int(rng.integers(2, 300))
            a = rng.integers(0, 1 << 62, n, dtype=np.uint64)
            keep = int(np.ceil(n * (0.5 + percent / 200)))
            b = np.concatenate([a[:keep], rng.integers(0, 1 << 62, int(rng.integers(0, 1 + n // 8)), dtype=np.uint64)])
            common = keep
            if 100 * common < percent * (n + len(b) - common) or n == len(b) == common:
                continue
            small, large = sorted((a, b), key=len)
            band = next(x for x in bands if x.lo <= len(large) <= x.hi)
            keys = [set(setjoin.segment_keys(x, np.zeros(len(x), np.int64), 1, band)[0].tolist()) for x in (small, large)]
            assert keys[0] & keys[1]


def test_jaccard_join_of_a_large_group_of_near_copies(documents, monkeypatch):
    """2,000 copies of one short text with one to three edits each, truncated ones among them: few pairs, no link lost."""
    rng = random.Random(12)
    base = [f"b{k}" for k in range(40)]
    rows = []
    for k in range(2000):
        w = list(base)
        for _ in range(rng.randrange(1, 4)):
            w[rng.randrange(40)] = f"e{rng.randrange(300)}"
        rows.append((k, " ".join(w[: 40 - rng.randrange(8)] if k % 5 == 0 else w)))
    made = []
    met = setjoin.met_pairs

    def counted(d, percent):
        out = met(d, percent)
        made.append((out[0].count(), out[1].count()))
        return out

    monkeypatch.setattr(setjoin, "met_pairs", counted)
    got = {r.doc_id: r.component_id for r in setjoin.jaccard_components(documents(rows), 3, 80).collect()}
    sets, held = {}, {}
    for doc, text in rows:
        w = text.split()
        sets[doc] = {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
        for g in sets[doc]:
            held.setdefault(g, []).append(doc)
    up = list(range(2000))

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    for a in range(2000):
        common = Counter(b for g in sets[a] for b in held[g] if b > a)
        for b, c in common.items():
            if 100 * c >= 80 * (len(sets[a]) + len(sets[b]) - c):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    assert got == {d: root(d) for d in range(2000)}
    assert sum(a + b for a, b in made) < 150 * 2000


def test_groups_below_the_threshold_take_no_differences(documents, monkeypatch):
    """300 texts that share two fifths of their words with each other: many common keys, hardly a similar pair. Such groups
    are told apart by parities; before, each was written out as its differences from a centre."""
    rng = random.Random(21)
    base = [f"b{k}" for k in range(60)]
    rows = []
    for k in range(300):
        w = list(base)
        at = rng.randrange(24)
        w[at : at + 36] = [f"x{k}_{j}" for j in range(36)]
        rows.append((k, " ".join(w)))
    rows += [(300 + k, text + " end") for k, text in rows[:40]]
    made = []
    monkeypatch.setattr(setjoin, "differences", lambda *a: made.append(a) or pytest.fail("differences of a small group"))
    near = setjoin.near_pairs
    monkeypatch.setattr(setjoin, "near_pairs", lambda *a: made.append(near(*a).count()) or near(*a))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in setjoin.jaccard_components(documents(rows), 3, 80).collect()}
    assert got == brute_components(rows, 3, 80)
    assert sum(made) < 400


def test_near_copies_of_several_lengths_are_not_divided(documents, monkeypatch):
    """Near copies of one text cut at several lengths, so that parities of two widths meet in a group."""
    rng = random.Random(22)
    base = [f"b{k}" for k in range(140)]
    rows = []
    for k in range(400):
        w = base[: rng.randrange(118, 141)]
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(40)}"
        rows.append((k, " ".join(w)))
    exploded = []
    rarest = setjoin._rarest
    monkeypatch.setattr(setjoin, "_rarest", lambda *a: exploded.append(a) or rarest(*a))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in setjoin.jaccard_components(documents(rows), 3, 90).collect()}
    assert got == brute_components(rows, 3, 90)
    assert not exploded


def test_parity_bounds_the_difference():
    rng = np.random.default_rng(5)
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 63, int(rng.integers(1, 400)), dtype=np.uint64))
        b = np.unique(np.concatenate([a[: int(rng.integers(0, len(a) + 1))], rng.integers(0, 1 << 63, int(rng.integers(1, 400)), dtype=np.uint64)]))
        u, v = (np.frombuffer(setjoin.parity(x), np.uint8) for x in (a, b))
        size = min(len(u), len(v))
        assert np.bitwise_count(setjoin.folded(u, size) ^ setjoin.folded(v, size)).sum() <= len(np.setxor1d(a, b))


def test_jaccard_awkward_rows(documents, awkward):
    d = documents(awkward, extra=True)
    out = setjoin.jaccard_components(d, 3, 90).collect()
    assert len(out) == len(awkward)
    assert {r.component_id for r in out if r.doc_id in (6, 7)} == {6}
    kept = setjoin.one_per_component(d, 5, 80)
    assert kept.columns == d.columns and 7 not in {r.doc_id for r in kept.collect()}
    assert setjoin.jaccard_components(documents([]), 3, 90).count() == 0


def test_one_row_per_component_without_telling_ids(documents):
    def near(name, edit):
        return " ".join([f"{name}{k}" for k in range(60)] + [edit])

    rows = [
        (1, near("a", "x")), (1, near("a", "x")), (None, near("a", "y")), (2, near("a", "z")),  # repeated row, copies with and without an id
        (None, near("b", "x")), (None, near("b", "y")), (None, near("b", "y")),  # no id at all
        (None, near("c", "x")), (3, near("c", "y")),  # a known id that comes later
        (4, near("d", "x")), (4, near("e", "x")),  # one id, two texts
        (None, near("f", "x")), (None, near("f", "x")),  # repeats without an id
        (None, None), (None, ""), (None, ""), (5, None),  # no words
    ]
    kept = [(r.doc_id, (r.text or "").split(" ")[0]) for r in setjoin.one_per_component(documents(rows, extra=True), 5, 80).collect()]
    want = [(1, "a0"), (None, "b0"), (3, "c0"), (4, "d0"), (4, "e0"), (None, "f0"), (None, ""), (None, ""), (None, ""), (5, "")]
    assert Counter(kept) == Counter(want)


def test_components_of_a_long_path(spark):
    nodes = spark.range(60).toDF("node")
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(50, 49)], "a long, b long")
    got = {r.node: r.label for r in label_components(nodes, links).collect()}
    assert all(got[k] == 0 for k in range(41)) and got[50] == got[49] == 49 and got[45] == 45


# --- outliers ---------------------------------------------------------------------------------------------------


def test_quality_rule_counts(documents, awkward):
    rows = awkward + [(50, "x y z\nx y z\n\n#$ x y z a\n#$ x y z a\nb"), (51, "a a a a a"), (52, "a b c a b c a b")]
    out = {r.doc_id: r for r in outliers.quality_verdicts(documents(rows, extra=True)).collect()}
    for doc, text, *_ in rows:
        w = words_of(text)
        seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {i + j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(3)}
        lines, dup, have = (text or "").split("\n"), 0, set()
        for x in lines:
            if words_of(x):
                dup += x in have
                have.add(x)
        r = out[doc]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r.kept and r.base_failed)
    assert outliers.quality_verdicts(documents([])).count() == 0


def test_outliers_are_rejected_and_clean_documents_stay(documents):
    rows = [(k, t) for k, t in enumerate(random_texts(150, 9, 4000, 160)) if len(t.split()) >= 50]
    odd = [(1000 + k, " ".join(w + "$$$" for w in t.split())) for k, (_, t) in enumerate(rows[:8])]
    out = outliers.quality_verdicts(documents(rows + odd)).collect()
    assert all(r.kept == (r.doc_id < 1000) for r in out)


def test_duplicate_lines_or_repeats_alone_are_rejected(documents):
    rng = random.Random(12)
    fresh = lambda n: [f"{rng.choice('bcdfgh')}{rng.randrange(10**5):05d}" for _ in range(n)]
    rows = [(k, "\n".join(" ".join(fresh(8)) for _ in range(20))) for k in range(200)]
    phrase = " ".join(fresh(7))
    both = "\n".join([" ".join(fresh(8))] * 8 + [" ".join(fresh(8)) for _ in range(10)])
    repeats = "\n".join(" ".join(fresh(8)) + " " + phrase for _ in range(10))
    little = "\n".join([" ".join(fresh(8))] * 2 + [" ".join(fresh(8)) for _ in range(18)])
    lone = "\n".join(f"{' '.join(fresh(4))}\nab\nab" for k in range(40))
    odd = [(1000, lone), (1001, repeats), (1002, both), (1003, little)]
    out = {r.doc_id: r for r in outliers.quality_verdicts(documents(rows + odd)).collect()}
    # two of three lines, each a single word; 47 % repeated words; both at about 40 %; one line of 20
    assert out[1000].n_repeat_words == 0
    assert [(out[k].base_failed, out[k].kept) for k in (1000, 1001, 1002, 1003)] == [(False, False), (False, False), (False, False), (False, True)]
    assert all(out[k].kept for k in range(200))


# --- mixing -----------------------------------------------------------------------------------------------------


def test_mix_targets_and_copies(documents, awkward):
    rng = random.Random(11)
    rows = [(k, " ".join(["w"] * rng.randrange(1, 60)), rng.choice(["a", "b", "b", "b", "b", "B", None])) for k in range(900)] + [(5000, None, "empty")]
    out = mixing.mix_sources(documents(rows, extra=True)).collect()
    assert len(out) == len(rows)
    size = Counter()
    for _, t, s in rows:
        size[s] += len(words_of(t))
    order = sorted([s for s in size if s is not None]) + [None]
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    target, free, left = {}, list(order), sum(size.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * size[s]]
        if not over:
            break
        for s in over:
            target[s] = 3 * size[s]
            left -= target[s]
            free.remove(s)
    target |= share
    taken = Counter()
    for r in out:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source])
        assert r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= 0.05 * target[s] + 60
    again = mixing.mix_sources(documents(rows).repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in out)


def test_mixed_documents_repeat_rows(documents, awkward):
    d = documents(awkward, extra=True)
    mixed = mixing.mixed_documents(d)
    assert mixed.columns == d.columns
    taken = mixing.mix_sources(d).agg(F.sum("copies")).first()[0]
    assert mixed.count() == taken
    assert mixing.mix_sources(documents([])).count() == 0


# --- pipeline ---------------------------------------------------------------------------------------------------


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in p.STAGES:
        out = stage(spark, docs, sf)
        path = str(tmp_path / name)
        out.write.parquet(path)
        kept[name], before, docs = spark.read.parquet(path), docs, spark.read.parquet(path)
        if name != "windows":
            assert docs.columns == columns
        if name == "quality":
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
            left = {r.doc_id for r in docs.collect()}
            assert np.mean([d in left for d, q in labels.items() if q == 1]) > 0.95
            rows = [(r.doc_id, r.text) for r in before.collect()]
            assert left == {d for (d, _), score in twin_scores(rows, list(labels.items())).items() if score >= 0.7}
        if name == "near_duplicates":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            assert {r.doc_id for r in docs.collect()} == {c for _, c in brute_components(rows, 5, 80).values()}
        if name == "repeated_passages":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            want = brute_substring(rows, 50)
            for r in docs.collect():
                assert hashlib.sha256(" ".join(words_of(r.text)).encode()).hexdigest() == want[r.doc_id][2] and r.n_chars == len(r.text)
        if name == "mix":
            counts = Counter(r.doc_id for r in docs.collect())
            assert max(counts.values()) <= 3 and set(counts) <= {r.doc_id for r in before.collect()}
            con = duckdb.connect()
            con.execute(f"create view documents as select * from read_parquet('{tmp_path}/repeated_passages/*.parquet')")
            taken = con.sql(f"select doc_id, size, taken from ({mixing.SQL})").fetchall()
            assert {d: n // size for d, size, n in taken if size and n} == {d: n for d, n in counts.items() if d in {x[0] for x in taken if x[1]}}
        if name == "windows":
            copies = Counter(r.doc_id for r in before.collect())
            tokens, whole = {}, {}
            for r in docs.collect():
                tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.length
                whole[r.doc_id] = r.doc_tokens
            # every id of every copy lies in one piece
            assert tokens == {d: n * whole[d] for d, n in copies.items()}
