"""Each operator against plain Python versions, on odd rows and on the smallest tables."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import plain
from shelfgrain.llm import common, embeddings, language, mixing, near_copies, packing, quality, queries, sharding, toxicity, url_rules, warc
from shelfgrain.llm.common import least_reachable, rolling, shingle_set, word_hashes

WORDS = "the of and river stone house light green seven paper window garden music yellow travel market simple".split()


def prose(seed, n):
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + str(draw.randrange(60)) for _ in range(n))


def odd_texts():
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    line = "one line that comes again and again in this text"
    return [
        None, "", " \t\n\v\f\r ", "word", "four words are here", "five words are right here", "Five WORDS are right here",
        base, base, " ".join(near), base.upper(), prose(2, 20000), "\n".join([line] * 30), "again " * 300,
        "\n".join([line, prose(3, 60), line, prose(4, 60)]), " ".join(w + "$$%%" for w in prose(5, 100).split()),
        "x" * 300_000, "naïve café \u00a0 über\u2003straße 漢字 🙂 \x01 a\x01b e\u0301", prose(6, 2046), prose(7, 1023),
    ]


CLASHING = ("size", "Target", "_row", "kept", "_quality", "_toxicity", "signature", "key", "a.b", "shard", "copies", "n")


@pytest.fixture(scope="module")
def odd(spark):
    """Odd documents: null ids and sources, repeated rows, columns named like those inside the operators."""
    rows = [(k, t, "en" if k % 2 else None, None if k % 5 == 0 else f"s{k % 3}", len(t or "")) for k, t in enumerate(odd_texts())]
    rows += [(None, "a text without id", "en", "s1", 17), (None, None, None, None, None), rows[7], rows[7], (3, prose(9, 80), "en", "s0", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    return docs.select("*", *[F.lit(7).alias(c) for c in CLASHING]).cache()


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def rows_of(frame):
    return [tuple(r) for r in frame.collect()]


def order(rows):
    return sorted(rows, key=repr)


def test_hashes():
    assert len(set(word_hashes(b"A a B b").tolist())) == 2
    long = (prose(1, 300_000)).encode()
    found = word_hashes(long)
    assert len(found) == 300_000 and len(set(found.tolist())) == len(set(long.split()))
    values = word_hashes(b"a b c a b c a b")
    assert rolling(values, 3)[0] == rolling(values, 3)[3] and len(rolling(values, 9)) == 0
    for text in odd_texts():
        assert len(shingle_set((text or "").encode(), 5)) == len(plain.shingles(text))


def test_components(spark):
    draw = random.Random(5)
    links = [(draw.randrange(300), draw.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1040)]
    got = dict(rows_of(least_reachable(spark.createDataFrame(links, "a long, b long"))))
    expected = plain.components({n for l in links for n in l}, links)
    assert all(got.get(n, n) == c for n, c in expected.items())


def test_mixing(spark, odd, docs):
    for given in (odd, docs):
        rows = given.select("doc_id", "text", "source").collect()
        got = mixing.mix_documents(given)
        result = got.collect()
        assert order((r.doc_id, r.size) for r in result) == order((r.doc_id, len(plain.words(r.text))) for r in rows)
        sizes = {}
        for r in rows:
            sizes[r.source] = sizes.get(r.source, 0) + len(plain.words(r.text))
        target = plain.targets(sizes)
        taken = sum(r.taken for r in result)
        largest = max(r.size for r in result)
        assert sum(sizes.values()) - largest <= taken <= sum(sizes.values())
        assert all(r.taken in [k * r.size for k in range(4)] for r in result)
        assert {round(r.target, 6) for r in result} <= {round(t, 6) for t in target.values()}
        assert order(result) == order(mixing.mix_documents(given).collect())
        copies = mixing.mixed_documents(given)
        assert copies.columns == given.columns
        assert sum(len(plain.words(r.text)) for r in copies.select("text").collect()) == taken
    assert mixing.mix_documents(odd.limit(0)).count() == 0
    assert mixing.mix_documents(odd.filter("text is null")).agg(F.sum("taken")).first()[0] == 0


def test_mixing_near_targets(spark):
    rows = [(k, "w " * (1 + k % 9), "abc"[k % 3] if k % 7 else None) for k in range(6000)]
    got = mixing.mix_documents(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    for r in got.join(spark.createDataFrame(rows, "doc_id long, text string, source string"), "doc_id").groupBy("source").agg(F.first("target"), F.sum("taken")).collect():
        assert abs(r[1] - r[2]) <= 0.02 * r[1] + 20


def test_quality_coverage_alone_decides(spark):
    """Texts that pass the base rules and hold no symbols: whether they stay is decided by coverage."""
    passage, line = prose(70, 60), "a line of eight words that comes again"
    own = [prose(100 + k, 70) for k in range(12)]
    texts = {
        "passage of 60 words eight times in 1,000": (" ".join(x for k in range(8) for x in (passage, own[k])), False),
        "two passages of 10 words, often": (" ".join(" ".join([prose(90, 10), *own[k].split()[:20]]) for k in range(12)), False),
        "a line six times among others": ("\n".join(x for k in range(6) for x in (line, own[k][:120])), False),
        "a line twice in a long text": ("\n".join([line, *own[:4], line]), True),
        "a passage quoted once more": (" ".join([*own[:8], " ".join(own[0].split()[:30])]), True),
        "no repetition": (" ".join(own), True),
    }
    frame = spark.createDataFrame([(k, t) for k, (t, _) in texts.items()], "doc_id string, text string")
    got = {r.doc_id: r for r in quality.judge_documents(frame).collect()}
    for name, (text, stays) in texts.items():
        assert not got[name].base_failed and got[name].n_symbols == 0, name
        assert (got[name].too_repetitive, got[name].kept) == (not stays, stays) == (plain.too_repetitive(text), plain.kept(text)), name


def test_quality(spark, odd, docs):
    for given in (odd, docs):
        texts = {}
        for r in given.select("doc_id", "text").collect():
            texts.setdefault(r.doc_id, []).append(r.text)
        got = quality.judge_documents(given).collect()
        assert len(got) == sum(map(len, texts.values()))
        for r in got:
            measured = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
            assert (measured, r.too_repetitive, r.kept) in [(plain.base_measures(t), plain.too_repetitive(t), plain.kept(t)) for t in texts[r.doc_id]]
        good = quality.good_documents(given)
        assert good.columns == given.columns and good.count() == sum(r.kept for r in got)
    assert quality.judge_documents(odd.limit(0)).count() == 0


def test_near_copies(spark, odd, docs):
    for given in (odd, docs):
        rows = [(r.doc_id, r.text) for r in given.select("doc_id", "text").collect()]
        expected = plain.near_copies([r for r in rows if r[0] is not None])
        got = near_copies.near_copies(given).collect()
        assert order((r.doc_id, r.n_shingles) for r in got) == order((i, len(plain.shingles(t))) for i, t in rows)
        for r in got:
            assert r.component_id == (None if r.doc_id is None else expected[r.doc_id]), r
        one = near_copies.one_of_each(given)
        assert one.columns == given.columns
        assert {r.doc_id for r in one.collect()} == {None if i is None else expected[i] for i, _ in rows}
    assert near_copies.near_copies(odd.limit(0)).count() == 0


def edited(text, seed, share):
    draw = random.Random(seed)
    return " ".join(w if draw.random() > share else f"new{draw.randrange(10**6)}" for w in text.split())


def test_near_copies_of_many_sizes(spark):
    """Groups around the limit, large groups, and a passage that many otherwise different texts share."""
    rows, passage = [], prose(99, 60)
    for group, size in enumerate((3, 6, 9, 20, 36, 40, 150, 260, 300, 700, 2100)):
        base = prose(group, size)
        rows += [edited(base, 100 * group + k, share) for k, share in enumerate((0, 0, 0.01, 0.02, 0.03, 0.04, 0.05, 0.06))]
    rows += [edited(prose(50, 90), 5000 + k, 0.03) for k in range(150)]
    rows += [passage + " " + prose(7000 + k, 25) for k in range(120)]
    rows += [passage] * 40
    rows = list(enumerate(rows))
    random.Random(1).shuffle(rows)
    expected = plain.near_copies(rows)
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == expected


def reworded(draw, words, edits, kinds=3):
    out = list(words)
    for _ in range(edits):
        at = draw.randrange(len(out))
        kind = draw.randrange(kinds)
        out[at:at + (kind != 1)] = [] if kind == 2 else [f"new{draw.randrange(10 ** 6)}"]
    return out


def test_near_copies_in_groups(spark, monkeypatch):
    """Groups around a text that is there or is missing, chains of edits, halves, and a passage that many share; links that only the second level of signatures finds."""
    draw, texts = random.Random(11), []
    for group in range(6):
        base = prose(200 + group, 60 + 15 * group).split()
        texts += [base] if group % 2 else []
        texts += [reworded(draw, base, 1 + k % 7, 1 + group % 3) for k in range(45)]
    chain = prose(300, 100).split()
    for _ in range(60):
        texts.append(chain)
        chain = reworded(draw, chain, 1 + draw.randrange(3))
    long = prose(301, 160).split()
    texts += [long[:160 - 4 * k] for k in range(20)] + [long[4 * k:] for k in range(20)]
    texts += [prose(302, 30).split() + prose(400 + k, 10 + k).split() for k in range(40)]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    draw.shuffle(rows)
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    made = []
    told = near_copies.told
    monkeypatch.setattr(near_copies, "told", lambda *given: made.append(told(*given)) or made[-1])
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain.near_copies(rows)
    assert made[0].count() < 6 * len(rows) and all(m.count() < 6 * len(rows) for m in made[1:])


def test_listed_differences_meet():
    """Sets of which one is not linked to the leader are similar only if they share a listed difference."""
    draw = random.Random(3)
    for _ in range(3000):
        size = draw.randrange(8, 60)
        leader = set(range(size))
        def member():
            own = set(leader)
            for _ in range(draw.randrange(size // 2 + 1)):
                own.discard(draw.randrange(size))
            return own | {100 + draw.randrange(40) for _ in range(draw.randrange(size // 2 + 1))}
        x = member()
        y = member() if draw.random() < 0.3 else {e for e in x if draw.random() < 0.95} | {200 + k for k in range(draw.randrange(3))}
        near = lambda a, b: 100 * len(a & b) >= 75 * len(a | b)
        if not x or not y or not near(x, y) or near(x, leader):
            continue
        def parted(own, as_near):
            ordered = sorted(own - leader) + sorted(leader - own)
            return set(ordered[:near_copies.listed(len(ordered), len(own), size, as_near)])
        assert parted(x, False) & parted(y, True)


def test_near_copies_of_repeated_rows(spark):
    """Rows that come twice, an uneven number of times, or as several versions of one id."""
    rows = []
    for group in range(6):
        base = prose(300 + group, 80)
        rows += [(2 * group, base), (2 * group + 1, edited(base, group, 0.02))]
    rows += [(20 + k, prose(400 + k, 80)) for k in range(4)]
    versions = [(30, prose(500, 80)), (30, prose(500, 80).upper()), (30, edited(prose(500, 80), 1, 0.02)), (31, edited(prose(500, 80), 2, 0.02))]
    for given in (rows + rows, rows * 4, rows + rows[::2], rows + rows + versions, versions):
        expected = plain.near_copies(given)
        assert len(set(expected.values())) < len(expected)
        docs = spark.createDataFrame(given, "doc_id long, text string")
        got = near_copies.near_copies(docs).collect()
        assert order((r.doc_id, r.component_id) for r in got) == order((i, expected[i]) for i, _ in given)


def test_one_of_each_of_repeated_rows(spark):
    """One row stays of rows with the same id, and of copies without id."""
    base, other, alone = prose(600, 80), prose(601, 80), prose(602, 80)
    rows = [(1, base, "a"), (1, base, "b"), (2, edited(base, 1, 0.02), "c"), (None, edited(base, 2, 0.02), "d"),
            (None, other, "e"), (None, other, "f"), (None, edited(other, 3, 0.02), "g"), (None, alone, "h"), (7, "", "i"), (7, "", "i")]
    for given in (rows, rows + rows):
        docs = spark.createDataFrame(given, "doc_id long, text string, `a.b` string").repartition(3)
        got = near_copies.one_of_each(docs)
        assert got.columns == docs.columns
        left = [(r[0], r[2]) for r in got.collect()]
        assert len(left) == 4 and {(1, "a"), (None, "h"), (7, "i")} < set(left) and set(left) & {(None, "e"), (None, "g")}


def test_signatures_meet():
    """Any two similar sets have a chosen signature in common."""
    draw = np.random.default_rng(3)
    none = np.empty(0, dtype=np.uint64)
    for size in (1, 2, 3, 4, 7, 12, 24, 31, 32, 33, 60, 190, 255, 256, 300, 1500, 2047, 2500):
        for _ in range(20):
            union = draw.integers(1, 1 << 63, size, dtype=np.uint64)
            union = np.unique(union)
            both = -(-3 * len(union) // 4)
            cut = draw.integers(0, len(union) - both + 1)
            order_ = draw.permutation(len(union))
            x, y = (np.sort(union[np.concatenate((order_[:both], part))]) for part in (order_[both:both + cut], order_[both + cut:]))
            common = np.sort(draw.choice(union, len(union) // 3, replace=False)) if draw.random() < 0.5 else none
            assert set(near_copies.chosen(x, common)[0].tolist()) & set(near_copies.chosen(y, common)[0].tolist())


def test_warc(spark, folder, tmp_path):
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", F.col("html").cast("binary").alias("payload"))
    odd_pages = spark.createDataFrame(
        [(9, "http://a/\r\nx y", b"same"), (2, None, b"same"), (5, "u", None), (4, "u", b""), (None, "v", b"same"), (None, "v", b"alone \r\n\r\n WARC/1.1"),
         (7, "http://b", b"twice"), (7, "http://b", b"twice"), (8, "long", b"ab" * 3_000_000), (1, "http://b", "ü漢".encode())],
        "page_id long, url string, payload binary")
    for name, given in (("pages", pages), ("odd", odd_pages)):
        target = f"file://{tmp_path}/{name}"
        manifest = warc.write_warc(given.withColumn("bytes", F.lit(1)), target, file_bytes=20_000)
        got = warc.read_warc(manifest, target)
        expected = order((r.page_id, len(r.payload or b""), plain.digest(bytes(r.payload or b""))) for r in given.collect())
        assert order((r.page_id, r.payload_bytes, r.payload_digest) for r in got.collect()) == expected
        first = {}
        for r in sorted(given.collect(), key=lambda r: (r.page_id is None, r.page_id or 0)):
            first.setdefault(bytes(r.payload or b""), r.page_id)
        by_digest = {plain.digest(p): i for p, i in first.items()}
        for r in got.collect():
            if r.record_type == "response":
                assert by_digest[r.payload_digest] == r.page_id and plain.digest(bytes(r.payload)) == r.payload_digest
            else:
                assert r.refers_to == by_digest[r.payload_digest] != r.page_id
        again = warc.write_warc(given.repartition(3), f"file://{tmp_path}/{name}-again", file_bytes=20_000)
        assert order(again.collect()) == order(manifest.collect())
        assert manifest.count() > 1
    digests = {r.payload_digest: r.record_type for r in warc.read_warc(warc.write_warc(odd_pages, f"file://{tmp_path}/least", least=5), f"file://{tmp_path}/least").collect()}
    assert digests[plain.digest(b"same")] == "response"
    assert warc.write_warc(odd_pages.limit(0), f"file://{tmp_path}/none").count() == 0


def test_warc_members():
    parts = [warc.record(k, f"http://x/{k}", bytes([k]) * k * 50, plain.digest(bytes([k]) * k * 50), None) for k in range(40)]
    raw = b"".join(parts)
    for step in (1, 7, 1000, len(raw)):
        got = [warc.parse_record(m) for m in warc.members(raw[k:k + step] for k in range(0, len(raw), step))]
        assert [g["page_id"] for g in got] == list(range(40)) and [len(g["payload"]) for g in got] == [50 * k for k in range(40)]
    with pytest.raises(ValueError):
        list(warc.members([raw[:-5]]))


def test_language(spark, odd, docs):
    got = language.predict_languages(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    sure = [r for r in got if r.held_out and r.lang]
    assert sum(r.lang == r.lang_pred for r in sure) >= 0.9 * len(sure) and len(got) == docs.count()
    assert all(r.held_out == plain.held_out(r.doc_id) and 0 <= r.score <= 1 for r in got)
    for r in language.predict_languages(odd).join(odd.select("doc_id", "text").distinct(), "doc_id").collect():
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    assert {r.lang_pred for r in language.predict_languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.predict_languages(odd.limit(0)).count() == 0


def test_language_profiles():
    """Distances of the kernel against sums over dictionaries."""
    profiles = {"x": language.most_frequent(*language.ngrams(prose(1, 300).encode()), language.PROFILE),
                "y": language.most_frequent(*language.ngrams("über straße größe müde schön ".encode() * 9), language.PROFILE)}
    predict = language.predictor(profiles)
    import pyarrow as pa
    for text in (prose(2, 50), "größe und schön", "ab"):
        ranks = language.most_frequent(*language.ngrams(text.encode()), language.DOCUMENT).tolist()
        sums = {}
        for name, profile in profiles.items():
            place = {g: k for k, g in enumerate(profile.tolist())}
            sums[name] = sum(abs(place[g] - k) if g in place else 400 for k, g in enumerate(ranks))
        best = min(sums, key=lambda n: (sums[n], n))
        got = predict(pa.array([text.encode()], pa.binary())).to_pylist()[0]
        assert got["lang_pred"] == best and abs(got["score"] - (1 - sums[best] / (400 * len(ranks)))) < 1e-12


def test_packing(spark, odd, docs):
    from tokenizers import Tokenizer
    import public_tokenizers
    whole = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    whole.encode_special_tokens = True
    for given in (odd, docs):
        expected = []
        for r in given.select("doc_id", "text").collect():
            ids = np.array(whole.encode(r.text or "", add_special_tokens=False).ids + [0], dtype="<u4")
            expected += [(r.doc_id, k, a, len(ids[a:a + 2048]), zlib.crc32(ids[a:a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
        got = packing.pack_documents(given).collect()
        assert order((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == order(expected)
        ends = {}
        for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
            assert ends.get(r.sequence_id, 0) == r.offset
            ends[r.sequence_id] = r.offset + r.length
        assert max(ends.values()) <= 2048
        assert len(ends) <= 1.02 * sum(ends.values()) / 2048 + 2
    with_ids = packing.pack(packing.tokenize(docs.limit(20), with_ids=True))
    built = {r.sequence_id: r.ids for r in packing.sequences(with_ids).collect()}
    for r in with_ids.collect():
        assert built[r.sequence_id][r.offset:r.offset + r.length] == r.ids
    assert packing.pack_documents(odd.limit(0)).count() == 0


def test_lookup_keeps_hot_keys_in_their_tasks(spark, monkeypatch):
    """A third of the rows under one key: it is broadcast, rows without key stay, and no row is doubled."""
    monkeypatch.setattr(common, "SMALL_ROWS", 10)
    monkeypatch.setattr("shelfgrain.session.BROADCAST_ROWS", 10)
    monkeypatch.setattr("shelfgrain.operators.joins.MIN_HOT_ROWS", 100)
    rows = spark.range(6000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN 'k' || id % 90 WHEN id % 9 = 2 THEN NULL ELSE 'none' || id END AS key")
    small = spark.range(90).selectExpr("'k' || id AS key", "id AS v").unionByName(spark.sql("SELECT 'hot' AS key, -1L AS v"))
    joined = common.lookup(rows, small, "key")
    known = {r.key: r.v for r in small.collect()}
    assert order((r.id, r.key, r.v) for r in joined.select("id", "key", "v").collect()) == order((r.id, r.key, known.get(r.key)) for r in rows.collect())
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan and "strategy=merge" in plan


def test_packing_rounds(spark, docs):
    """Slices that adaptive execution may not merge, so that pieces have to be carried on; against best fit piece by piece."""
    draw = random.Random(8)
    lengths = [draw.choice((draw.randint(1, 2048), draw.randint(1, 300), 2048, 700)) for _ in range(3000)] + [1025] * 400
    made = spark.createDataFrame([(k, 0, n) for k, n in enumerate(lengths)], "doc_id long, piece int, length long")
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        for given in (made, made.filter("length > 1024"), made.filter("length < 3"), made.limit(1), packing.tokenize(docs).select("doc_id", "piece", "length")):
            got = packing.pack(given, slice_rows=200).collect()
            assert order((r.doc_id, r.piece, r.length) for r in got) == order(tuple(r) for r in given.collect())
            ends = {}
            for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
                assert ends.get(r.sequence_id, 0) == r.offset
                ends[r.sequence_id] = r.offset + r.length
            assert max(ends.values()) <= 2048
            counts = Counter(r.length for r in got)
            best = max(first + -(-n // each) for _, _, n, first, each, _ in plain.plan_places(counts, 2048))
            assert len(ends) <= 1.02 * best + 1
    finally:
        spark.conf.set(key, before)


def test_packing_carried_runs():
    """Runs use every piece and gap once at most, pieces fit, and nothing that fits is left to an open gap."""
    for seed in range(200):
        draw = random.Random(seed)
        size, slices = 1, []
        for number in range(draw.randint(1, 9)):
            longest = size + draw.randint(0, 20)
            least = longest + draw.randint(0, 20)
            size = least
            slices.append((number, draw.choice((0, draw.randint(1, 30))), longest, draw.choice((0, draw.randint(1, 30))), least))
        pieces, gaps = {}, Counter()
        for below, rank, n, each, above, first in packing.carried(slices):
            assert below < above and n > 0 and each * slices[below][2] <= slices[above][4]
            assert rank == pieces.get(below, 0) and first == gaps[above]
            pieces[below] = rank + n
            gaps[above] += -(-n // each)
        for number, n, _, m, _ in slices:
            assert pieces.get(number, 0) <= n and gaps[number] <= m
            if gaps[number] < m:
                assert all(pieces.get(k, 0) == slices[k][1] for k in range(number))


def test_packing_runs_are_bounded():
    draw = random.Random(5)
    for capacity in (1, 2, 7, 64, 2048):
        for most in (1, 3, 1000, 10**9):
            counts = {n: draw.randint(1, most) for n in range(1, capacity + 1)}
            assert len(plain.plan_places(counts, capacity)) <= plain.most_runs(len(counts), capacity)


def test_packing_plan():
    """The plan for classes against best fit, document by document."""
    for seed in range(30):
        draw = random.Random(seed)
        capacity = draw.choice((10, 16, 64))
        counts = {n: draw.randrange(1, 12) for n in range(1, capacity + 1) if draw.random() < 0.6}
        gaps = []
        for length in sorted(counts, reverse=True):
            for _ in range(counts[length]):
                fit = min((g for g in gaps if g >= length), default=None)
                if fit is None:
                    gaps.append(capacity - length)
                else:
                    gaps.remove(fit)
                    gaps.append(fit - length)
        used = {}
        for length, rank, n, first, each, offset in plain.plan_places(counts, capacity):
            for k in range(n):
                used.setdefault(first + k // each, []).append((offset + k % each * length, length))
        assert len(used) == len(gaps)
        for pieces in used.values():
            end = 0
            for at, length in sorted(pieces):
                assert at == end
                end += length
            assert end <= capacity
        assert sum(len(p) for p in used.values()) == sum(counts.values())


def test_url_rules(spark, folder):
    rules = [*queries.URL_RULES, ("example.org", "/", "allow"), ("example.org", "/en/", "allow"), ("www.example.org", "/en/1/", "allow"), ("net", "", "block"), ("", "/", "block"), ("b.a", "/x", "allow"), ("b.a", "/x", "block")]
    urls = [None, "", "no scheme", "http://", "http://ORG/", "http://org", "http://org?x", "http://a.b.org/#f", "https://www.Example.org/en/1/2?q", "https://example.org/en/12",
            "http://xexample.org/es/1", "http://example.org/es", "http://example.org/es/", "http://com/fr/", "http://a.com/de/x", "http://com./de/", "http://.com/de/", "http://user@x.net:80/",
            "http://x.net", "http://c.b.a/xyz", "http://b.a/x", "http://b.a/", "http://com/a://b/fr/", "http://com/fr/\n\x00\U0010ffff", "http://com/de/\U0010ffff", "x" * 5000 + "://org/", "http://" + "a." * 300 + "org/", "http://com/fr/"]
    given = [(k, u) for k, u in enumerate(urls)] + [(None, "http://com/fr/"), (7, urls[7])]
    pages = spark.createDataFrame(given, "page_id long, url string").withColumn("rule", F.lit(1)).withColumn("top", F.lit(2))
    stored = spark.read.parquet(f"{folder}/pages.parquet")
    table = lambda r: spark.createDataFrame(list(r), "host string, path string, verdict string")
    for some in (rules, queries.URL_RULES, []):
        for frame in (pages, stored):
            expected = order((r.page_id, *plain.judged(r.url, sorted(some, key=lambda x: x[2]))) for r in frame.select("page_id", "url").collect())
            assert order(rows_of(url_rules.judge_pages(frame, table(some)))) == expected
    assert url_rules.judge_pages(pages.limit(0), table(rules)).count() == 0


def test_toxicity(spark, odd):
    rude = ["loser", "clown", "moron"]
    rows, labels = [], []
    for k in range(900):
        text = prose(k, 80)
        toxic = k % 6 == 0
        rows.append((k, text + " " + " ".join(random.Random(k).sample(rude, 2)) + "!" if toxic else text))
        if k % 2 == 0:
            labels.append((k, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels + [(None, 1), (10**6, 1), (0, None)], "doc_id long, toxic int").withColumn("text", F.lit("x"))
    got = toxicity.score_documents(docs, marks).collect()
    held = [r for r in got if r.held_out]
    assert all(r.predicted == (r.doc_id % 6 == 0) for r in held) and len(got) == 900
    assert all(r.held_out == plain.held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    clean = toxicity.clean_documents(docs, marks)
    assert clean.columns == docs.columns and clean.count() == sum(1 - r.predicted for r in got)
    # Labels of held-out documents change nothing.
    other = marks.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert order(toxicity.score_documents(docs, other).collect()) == order(got)
    assert toxicity.score_documents(odd, marks).count() == odd.count()
    assert {r.score for r in toxicity.score_documents(docs, marks.limit(0)).collect()} == {0.0}
    assert toxicity.clean_documents(odd, marks).columns == odd.columns
    assert toxicity.score_documents(odd.limit(0), marks).count() == 0


def test_toxicity_trains_on_features_that_stand_out(spark, monkeypatch):
    """A training task gets of each text only the features with weights; these are the ones that plain counts name."""
    docs = spark.createDataFrame([(k, prose(k, 80) + (" loser clown" if k % 6 == 0 else "")) for k in range(900)], "doc_id long, text string")
    marks = spark.createDataFrame([(k, int(k % 6 == 0)) for k in range(0, 900, 2)], "doc_id long, toxic int")
    given, kind = [], type(docs.groupBy("doc_id"))
    apply = kind.applyInPandas
    monkeypatch.setattr(kind, "applyInPandas", lambda self, *rest: given.append(self._df) or apply(self, *rest))
    model, _ = toxicity.learn(docs, marks)
    lists = next(c for c, t in given[0].dtypes if t.startswith("array"))
    assert 0 < given[0].agg(F.max(F.size(lists))).first()[0] <= np.count_nonzero(model) < 100

    draw = np.random.default_rng(3)
    rate, lift = np.linspace(0.01, 0.2, 300), np.tile([1, 3, 4, 8], 75)
    rows = [(int(draw.integers(4)), k % 3 == 0, np.flatnonzero(draw.random(300) < rate * (lift if k % 3 == 0 else 1)).tolist()) for k in range(600)]
    found = toxicity.standing_out(spark.createDataFrame(rows, "bag int, toxic boolean, features array<int>"), 0.1)
    for bag in range(toxicity.BAGS):
        texts = {t: [f for b, own, f in rows if b != bag and own == t] for t in (True, False)}
        in_p, in_u = (np.bincount(np.concatenate(texts[t]).astype(int), minlength=300) for t in (True, False))
        expected = in_u * len(texts[True]) / len(texts[False])
        assert found[bag].tolist() == np.flatnonzero((in_p >= 4) & (in_p >= 4 * expected) & (in_p >= expected + 5 * np.sqrt(expected + 0.25))).tolist()
        assert 0 < len(found[bag]) < 300


def test_a_worker_keeps_words_for_packing_only():
    path = packing.public_tokenizers.path(packing.TOKENIZER)
    kept = packing.encoder(path)
    assert packing.encoder(path) is kept
    assert list(common.tidy("another", iter)([1, 2])) == [1, 2]
    assert packing.encoder(path) is not kept


def test_toxicity_of_repeated_rows(spark):
    """Repeated rows and labels of documents that are not at hand teach nothing more."""
    rows = [(k, prose(k, 40) + (" loser clown" if k % 6 == 0 else "")) for k in range(200)]
    schema, marked = "doc_id long, text string", "doc_id long, toxic int"
    labels = [(k, int(k % 6 == 0)) for k in range(0, 200, 2)]

    def scores(docs, marks):
        return {r.doc_id: r.score for r in toxicity.score_documents(spark.createDataFrame(docs, schema), spark.createDataFrame(marks, marked)).collect()}

    expected = scores(rows, labels)
    for docs, marks in ((rows + [rows[6]] * 100 + [rows[8]] * 100, labels), (rows, labels + [(k, 1) for k in range(1000, 1300)])):
        got = scores(docs, marks)
        assert all(abs(got[k] - expected[k]) < 1e-6 for k in expected)


def test_embeddings(spark, folder):
    draw = np.random.default_rng(8)
    rows = []
    for _ in range(60):
        base = draw.standard_normal(32)
        rows += [(base + draw.standard_normal(32) * s).tolist() for s in (0, 0.05, 0.1, 0.15, 0.2, 0.25)]
    hot = draw.standard_normal(32)
    rows += [(hot + draw.standard_normal(32) * 0.05).tolist() for _ in range(1500)] + [hot.tolist()] * 50
    rows += [None, [], [0.0] * 32, [None] + [1.0] * 31, [float("nan")] + [1.0] * 31, [float("inf")] * 32, [1.0, 0.0], [2.0, 0.0], [-0.0, 3.0], [0.0, 3.0], (2 * hot).tolist()]
    given = [(k, v) for k, v in enumerate(rows)]
    links = plain.near_vectors(given)
    frame = spark.createDataFrame(given, "vec_id long, embedding array<double>").withColumn("label", F.lit(1)).withColumn("node", F.lit(1))
    got = {r.vec_id: r for r in embeddings.near_vectors(frame).collect()}
    found = sum(r.n_links for r in got.values()) / 2
    assert len(got) == len(rows) and 0.995 * len(links) <= found <= len(links)
    parts = plain.components(range(len(rows)), links)
    assert sum(got[k].component_id == c for k, c in parts.items()) >= 0.995 * len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    stored = spark.read.parquet(f"{folder}/embeddings.parquet")
    expected = plain.near_vectors([(r.vec_id, r.embedding) for r in stored.collect()])
    assert embeddings.near_vectors(stored).agg(F.sum("n_links")).first()[0] == 2 * len(expected)
    repeated = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert order(rows_of(embeddings.near_vectors(repeated).select("vec_id", "n_links", "component_id"))) == order([(1, 2, 1), (1, 2, 1), (None, 2, None)])
    assert embeddings.near_vectors(frame.limit(0)).count() == 0


def test_sharding(spark, odd, docs):
    for given in (odd, docs):
        rows = given.select("doc_id", "text").collect()
        got = sharding.shard_documents(given, [1.0] * 40).collect()
        assert order((r.doc_id, r["size"], r.text_crc32) for r in got) == order((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in rows)
        slots = {}
        for r in got:
            slots.setdefault(r.shard, []).append(r.slot)
            assert r.grown_shard in (r.shard, 40) and r.law == "key"
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(odd.limit(0), [1.0] * 40).count() == 0


def test_sharding_hash(spark):
    """Shards recomputed with a hash library, and shares by weight."""
    import math
    import struct

    import xxhash
    weights = [1.0, 2.0, 0.5]

    def shard(key):
        best = []
        for s, w in enumerate(weights):
            h = xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
            h = xxhash.xxh64_intdigest(struct.pack("<i", s), h)
            best.append((w / -math.log(((h >> 11) + 0.5) / (1 << 53)), -s))
        return -max(best)[1]

    got = sharding.assign_shards(spark.range(7000).toDF("id"), "id", weights).collect()
    assert all(r.shard == shard(r.id) for r in got)
    for s, w in enumerate(weights):
        assert abs(sum(r.shard == s for r in got) / 7000 - w / 3.5) < 0.03
    grown = {r.id: r.shard for r in sharding.assign_shards(spark.range(7000).toDF("id"), "id", [*weights, 1.0]).collect()}
    assert all(grown[r.id] == r.grown_shard for r in got)
    with pytest.raises(ValueError):
        sharding.assign_shards(spark.range(1).toDF("id"), "id", [1.0, 0.0])
