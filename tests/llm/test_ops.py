"""Every operator against a brute-force version on small tables, with nulls, empty and long texts, ties, repeated rows and extra columns."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from scenelake.llm import exchange, op1_simhash, op2_toxicity, op3_mix, op4_substring, op5_decontaminate, op6_licenses, op7_suffix, op8_language, op9_tiff, op10_tokens
from scenelake.llm.components import connected
from scenelake.llm.suffix_array import permuted_prefixes, suffix_array

SCHEMA = "doc_id long, text string, lang string, source string, g int, key string, rest string, size int, fp long"
random.seed(11)
VOCABULARY = ["the", "of", "and", "über", "ça", "x", "thonre", "erst", "rain", "a.", "B", "zz9"] + [f"w{i}" for i in range(300)]


def prose(n: int) -> str:
    return " ".join(random.choice(VOCABULARY) for _ in range(n))


BASE = prose(400)
PASSAGE = prose(60)
TEXTS = [
    BASE, BASE, BASE + " tail", None, "", "  \t\n ", "one", "one two", PASSAGE, prose(30) + " " + PASSAGE + " " + prose(30), prose(80) + "\n" + PASSAGE,
    " ".join(["again"] * 90), prose(5000), prose(100), "é" * 150, "é" * 151, PASSAGE.upper(), prose(19), prose(20), BASE[: len(BASE) // 2], "日本語" * 60 + " 😀",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3 + 1, t, ["en", "de", None][i % 3], ["s1", "s2", None][i % 3], i, "k", "r", i, i) for i, t in enumerate(TEXTS)]
    rows += [rows[2], (None, BASE, None, None, 0, None, None, 0, 0), (None, None, "en", "s1", 0, None, None, 0, 0)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def named(docs) -> list[tuple[int, bytes]]:
    """Rows in the order that decides which repeat is the earlier: by id, then text."""
    return sorted((r.doc_id, (r.text or "").encode()) for r in docs.collect() if r.doc_id is not None)


def runs(gone: list[bool]) -> int:
    return sum(x and not y for x, y in zip(gone, [False, *gone], strict=False))


# 1


def brute_fingerprint(text: str) -> int:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(c, " ")
    words = [w for w in lowered.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_op1(docs, empty):
    got = op1_simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    texts = {}
    for r in docs.collect():
        texts.setdefault((r.doc_id, brute_fingerprint(r.text)), 0)
    assert {(r.doc_id, int(r.fingerprint, 16)) for r in got} == set(texts)
    ids = sorted((i, f) for i, f in texts if i is not None)
    root = {i: i for i, _ in ids}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, f in ids:
        for j, h in ids:
            if bin(f ^ h).count("1") <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert {(r.doc_id, r.component_id) for r in got if r.doc_id is not None} == {(i, find(i)) for i in root}
    assert {r.component_id for r in got if r.doc_id is None} == {1, find(10)}
    assert op1_simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("members", [2, 5, 24, 25, 500])
def test_op1_links_of_dense_groups(spark, members):
    base = random.getrandbits(64)
    fps = {base} | {base ^ (1 << random.randrange(64)) ^ (1 << random.randrange(64)) for _ in range(members)} | {random.getrandbits(64) for _ in range(60)}
    fps = sorted(f - (1 << 64) if f >= 1 << 63 else f for f in fps)
    pairs = [(r.a, r.b) for r in op1_simhash.linked_pairs(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()]
    assert len(pairs) <= 65 * len(fps)
    assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= 2 for a, b in pairs)

    def groups(edges):
        root = {f: f for f in fps}

        def find(a):
            while root[a] != a:
                a = root[a]
            return a

        for a, b in edges:
            root[find(a)] = find(b)
        out = {}
        for f in fps:
            out.setdefault(find(f), set()).add(f)
        return sorted(map(sorted, out.values()))

    assert groups(pairs) == groups([(a, b) for a in fps for b in fps if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 2])


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 105), (105, 103), (200, 200)]
    random.shuffle(chain)
    got = {r.node: r.root for r in connected(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 105: 100, 103: 100}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


# 2 and 8


def test_op2_learns_pairs():
    calm, insult, group = "calm words here", "dolt", "folk"
    rows = [((prose(20) + f" {a} {b}").encode(), int(bool(a) and bool(b))) for a in ("", insult) for b in ("", group) for _ in range(60)] + [(calm.encode(), 0)] * 5
    random.shuffle(rows)
    m = op2_toxicity.fit(rows)
    say = lambda t: m.score(t.encode())
    assert say(f"{prose(10)} {insult} {group}") > say(f"{prose(10)} {insult}") and say(f"{insult} {group}") > 0.5 > say(prose(10))
    assert np.abs(m.factors).max() > 0.02


def test_op2(spark, sf, docs, empty):
    rows = op2_toxicity.op2(spark, sf).collect()
    assert len(rows) == 200 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    machine = op2_toxicity.fit([])
    scored = op2_toxicity.score_toxicity(docs, machine).collect()
    assert len(scored) == docs.count() and len({r.score for r in scored}) == 1
    assert op2_toxicity.score_toxicity(empty, machine).count() == 0
    assert op2_toxicity.train(docs, spark.createDataFrame([(None, 1), (1, None)], "doc_id long, toxic int")).score(b"x") >= 0


def test_op2_conflicting_labels_and_scores(spark):
    rows = [(i, f"{prose(12)} {'dolt folk' if i % 3 == 0 else 'calm'}") for i in range(300)] + [(5, "another text under the same id")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = [(i, int(i % 3 == 0)) for i in range(300)] + [(6, 0), (5, 1), (5, None)]
    trained = [op2_toxicity.train(docs.repartition(n), spark.createDataFrame(labels[::step], "doc_id long, toxic int")) for n, step in ((3, 1), (5, -1))]
    assert (trained[0].hashes == trained[1].hashes).all() and (trained[0].factors == trained[1].factors).all()
    m = trained[0]
    for text in ("dolt folk here", "calm", "", "dolt " * 50):
        own = [i for h in op2_toxicity.terms(text.encode()) if (i := m.index.get(h)) is not None]
        z = m.bias + sum(m.linear[i] for i in own) + sum(float(m.factors[a] @ m.factors[b]) for k, a in enumerate(own) for b in own[:k])
        assert m.score(text.encode()) == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)


def test_op2_held_out(spark):
    rows = op2_toxicity.op2(spark, "/root/testdata/sf0.1").where("held_out").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").select("toxic", "predicted").collect()
    hit = sum(r.toxic and r.predicted for r in rows)
    assert hit / sum(r.toxic for r in rows) > 0.75 and hit / max(1, sum(r.predicted for r in rows)) > 0.95


def test_op8(spark, sf, docs, empty):
    known = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op8_language.op8(spark, sf).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 200 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(known[r.doc_id] == r.lang_pred for r in held) / len(held) > 0.97
    model = op8_language.train(docs)
    out = op8_language.detect(docs, model).collect()
    assert len(out) == docs.count()
    assert {r.lang_pred for r in out} <= {"en", "de", "und"} and all(0 <= r.score <= 1 for r in out)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 --"), (4, "日本")], "doc_id long, text string")
    assert [r.lang_pred == "und" for r in op8_language.detect(odd, model).orderBy("doc_id").collect()] == [True, True, True, False]
    assert op8_language.detect(empty, op8_language.train(empty)).count() == 0
    assert op8_language.keep_known(docs).columns == docs.columns


def test_op8_rejects_what_is_far(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = op8_language.train(docs)
    draw = random.Random(3)
    junk = lambda n, letters: " ".join("".join(draw.choice(letters) for _ in range(draw.randint(2, 9))) for _ in range(n))
    alphabets = ["abcdefghijklmnopqrstuvwxyz", "".join(chr(0x4E00 + i) for i in range(2000)), "".join(chr(0x430 + i) for i in range(32))]
    foreign = [junk(n, a) for n in (30, 300, 3000) for a in alphabets]
    rows = [(i, t, "en") for i, t in enumerate(foreign)] + [(100, "Avec.", None), (101, None, None), (102, "12 --", None)]
    planted = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in op8_language.detect(planted, model).collect()}
    assert all(out[i].rejected and out[i].lang_pred != "und" for i in range(len(foreign))) and not out[100].rejected and out[101].rejected and out[102].lang_pred == "und"
    mixed = docs.select("doc_id", "text", "lang").unionByName(planted.withColumn("lang", F.lit(None).cast("string")).withColumn("doc_id", F.col("doc_id") + 10**6))
    kept = {r.doc_id for r in op8_language.keep_known(mixed).select("doc_id").collect()}
    assert docs.where("text is not null").count() - len([i for i in kept if i < 10**6]) <= 5 and {i - 10**6 for i in kept if i >= 10**6} <= {100}


def test_op8_is_the_nearest_centroid():
    texts = [(x, prose(40)) for x in ("a", "b") for _ in range(12)]
    rows = [(x, next(op8_language.bags([t.encode()])), None) for x, t in texts]
    model = op8_language.fit(rows)
    for text in ("the rain of w1", "thonre erst über", prose(30)):
        counts = {}
        folded = " ".join("".join(c if c.isalpha() or ord(c) > 127 else " " for c in text.lower()).split()).encode()
        line = b" " + folded + b" "
        for i in range(len(line) - 2):
            h = ((line[i] << 16 | line[i + 1] << 8 | line[i + 2]) * 2654435761) % 2**32 >> 17
            counts[h] = counts.get(h, 0) + 1
        vector = np.zeros(op8_language.BUCKETS)
        for h, n in counts.items():
            vector[h] = np.log1p(n) * model.idf[h]
        cosines = vector / np.linalg.norm(vector) @ model.weights / np.linalg.norm(model.weights, axis=0)
        (name,), (score,), _ = model.predict([text.encode()])
        assert name == model.languages[int(cosines.argmax())] and score == pytest.approx(cosines.max(), abs=1e-5)


def test_op8_learns_every_language(spark):
    rows = [(i, f"{chr(97 + i % 26) * 3}{chr(97 + i // 26) * 4} {prose(2)}", f"l{i}") for i in range(230)]
    model = op8_language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(set(model.languages)) == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(230))


# 3


def test_op3(docs, empty, spark):
    mixed = op3_mix.mix_sources(docs)
    rows = mixed.collect()
    assert len(rows) == docs.count()
    sizes = {}
    for r in docs.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len((r.text or "").encode().split())
    names = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, full = {}, set()
    while len(full) < len(names):
        left, share = sum(sizes.values()) - sum(target[s] for s in full), sum(weights[s] for s in names if s not in full)
        over = [s for s in names if s not in full and left * weights[s] / share > 3 * sizes[s]]
        if not over:
            target |= {s: left * weights[s] / share for s in names if s not in full}
            break
        full |= set(over)
        target |= {s: 3.0 * sizes[s] for s in over}
    assert all(r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, op3_mix.mix_sources(docs.repartition(3)).collect()))
    assert op3_mix.mix_sources(empty).count() == 0
    blank = op3_mix.mix_sources(spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")).collect()
    assert [(r.target, r.taken) for r in blank] == [(0.0, 0)] * 2
    unique = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    again = op3_mix.mix_sources(unique)
    assert op3_mix.emit(unique, again).count() == again.selectExpr("sum(copies)").first()[0]


def test_op3_more_shelves_for_a_hot_source(spark):
    rows = [(i, "w " * (i % 50), f"s{int(i % 3 == 0)}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for r in op3_mix.mix_sources(docs, shelf_rows=20).groupBy("source").agg({"taken": "sum", "target": "max"}).collect():
        assert r["sum(taken)"] == pytest.approx(r["max(target)"], rel=0.02)
    clash = docs.limit(20).withColumn("copy", F.lit("mine")).withColumn("copies", F.lit(9))
    out = op3_mix.emit(clash, op3_mix.mix_sources(clash))
    assert out.columns == ["doc_id", "text", "source", "copy_given", "copies", "copy"] and {r.copy_given for r in out.collect()} == {"mine"}


def test_op3_comes_near_target(spark):
    rows = [(i, "w " * (5 + i * 37 % 200), f"s{i % 4 if i % 3 else 0}") for i in range(4000)]
    for r in op3_mix.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source").agg({"taken": "sum", "target": "max"}).collect():
        assert r["sum(taken)"] == pytest.approx(r["max(target)"], rel=0.01)


# 4 and 7


def brute_words(docs, window):
    seen, out = set(), []
    for i, text in named(docs):
        words = text.split()
        gone = [False] * len(words)
        for p in range(len(words) - window + 1):
            key = tuple(words[p : p + window])
            if key in seen:
                gone[p : p + window] = [True] * window
            seen.add(key)
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((i, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def brute_bytes(docs, window):
    seen, out = set(), []
    for i, text in named(docs):
        gone = [False] * len(text)
        for p in range(len(text) - window + 1):
            if text[p : p + window] in seen:
                gone[p : p + window] = [True] * window
            seen.add(text[p : p + window])
        kept = bytes(b for b, g in zip(text, gone, strict=True) if not g)
        out.append((i, len(text), sum(gone), runs(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.where("doc_id is not null").collect())


def test_op4(docs, empty):
    got = op4_substring.remove_repeats(docs)
    assert got.count() == docs.count()
    want = brute_words(docs, 20)
    assert rows_of(got) == want and sum(x[2] for x in want) > 500
    assert {r.n_removed for r in got.where("doc_id is null").collect()} == {0}
    assert op4_substring.remove_repeats(empty).count() == 0
    with pytest.raises(ValueError):
        op4_substring.remove_repeats(docs, 18, 10)


@pytest.mark.parametrize("crowd", [1, 400])
def test_op7(docs, empty, crowd):
    got = op7_suffix.remove_repeats(docs, crowd=crowd)
    assert got.count() == docs.count()
    want = brute_bytes(docs, 100)
    assert rows_of(got) == want and sum(x[2] for x in want) > 3000
    assert {r.n_removed for r in got.where("doc_id is null").collect()} == {0}
    assert op7_suffix.remove_repeats(empty, crowd=crowd).count() == 0


def test_op7_rewrites_whole_characters(docs, empty):
    cut = op7_suffix.cut_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    by_id = {r.doc_id: r for r in cut.collect()}
    assert by_id[1].text == BASE and by_id[4].text == "" and by_id[10].text is None
    assert by_id[1].lang == "en" and by_id[1].fp == 0 and op7_suffix.cut_repeats(empty).count() == 0


def test_random_passages(spark):
    pieces = [prose(random.randrange(5, 60)) for _ in range(12)]
    rows = spark.createDataFrame([(i, " ".join(random.choice(pieces) if random.random() < 0.5 else prose(12) for _ in range(8))) for i in range(80)], "doc_id long, text string").repartition(6)
    assert rows_of(op4_substring.remove_repeats(rows)) == brute_words(rows, 20)
    for crowd in (2, 400):
        assert rows_of(op7_suffix.remove_repeats(rows, crowd=crowd)) == brute_bytes(rows, 100)


@pytest.mark.parametrize("alphabet", [b"a", b"ab", b"\x00a", bytes(range(256))])
def test_suffix_array(alphabet):
    for n in (1, 2, 3, 7, 40, 300):
        for _ in range(5):
            t = bytes(random.choice(alphabet) for _ in range(n))
            order = suffix_array(np.frombuffer(t, np.uint8))
            assert order.tolist() == sorted(range(n), key=lambda i: t[i:])
            shared = permuted_prefixes(np.frombuffer(t, np.uint8), order)
            for a, b in zip(order[1:], order[:-1], strict=True):
                k = 0
                while a + k < n and b + k < n and t[a + k] == t[b + k]:
                    k += 1
                assert shared[a] == k


def test_long_prefixes():
    t = np.frombuffer(bytes(random.choice(b"abc") for _ in range(2000)) * 2, np.uint8)
    order = suffix_array(t)
    assert order.tolist() == sorted(range(4000), key=lambda i: t.tobytes()[i:])
    shared = permuted_prefixes(t, order)
    assert all(shared[i] == 2000 - i for i in range(1, 1900, 90))


@pytest.mark.parametrize("window", [300, 600, 2000])
def test_op7_windows(spark, window):
    long = prose(900)
    rows = spark.createDataFrame([(1, long), (2, prose(20) + long), (3, long[: len(long) // 2] + prose(300)), (4, None), (5, long)], "doc_id long, text string")
    want = brute_bytes(rows, window)
    assert rows_of(op7_suffix.remove_repeats(rows, window)) == want and sum(x[2] for x in want) > 5000


def test_op4_compares_words_not_hashes(spark):
    """Polynomial hashes modulo 2^64 take a Thue-Morse word and its complement for the same, whatever the base."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    one, other = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    head = prose(19)
    rows = spark.createDataFrame([(1, f"{head} {one}"), (2, f"{head} {other}"), (3, f"{prose(5)} {head} {other}"), (4, "x" * 1_000_000 + " " + head), (5, "x" * 1_000_000 + " " + head)], "doc_id long, text string")
    want = brute_words(rows, 20)
    assert rows_of(op4_substring.remove_repeats(rows)) == want and [x[2] for x in want] == [0, 0, 20, 0, 20]


def test_sql_of_4_and_7(spark, sf):
    import duckdb

    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    for query, oracle in ((op4_substring.op4, op4_substring.oracle()), (op7_suffix.op7, op7_suffix.oracle())):
        got = query(spark, sf)
        assert sorted(map(tuple, got.collect())) == sorted(db.sql(f"SELECT {', '.join(got.columns)} FROM ({oracle})").fetchall())


def test_packing():
    values = np.sort(np.random.default_rng(0).integers(0, 2**64, 100, np.uint64))
    assert (exchange.unpack(exchange.pack(values), 100) == values).all()
    column = np.array([-5, 0, 2**40], np.int64)
    assert (exchange.unpack_column(exchange.pack_column(column), 3, np.int64) == column).all()


# 5


def brute_leaks(texts, items, rate=0.2):
    value = lambda t: op5_decontaminate.words_of([t.encode()]).value
    out = set()
    for d, t in texts:
        for k, item in items:
            v, w = value(item or ""), value(t or "")
            if len(v) and len(w) and op5_decontaminate.edits(v, w)[0] <= int(rate * len(v) + 1e-9):
                out.add((d, k))
    return out


def test_op5(spark, docs, empty):
    items = [(i, prose(n)) for i, n in enumerate((8, 15, 22, 30, 45, 60, 90))] + [(90, None), (91, ""), (92, "..."), (93, "lonely")]
    texts = [(0, prose(200)), (1, None), (2, "")]
    for k, item in items[:7]:
        words = item.split()
        for j, share in enumerate((0, 0.1, 0.2, 0.5)):
            w = list(words)
            for _ in range(int(share * len(w))):
                p = random.randrange(len(w))
                w[p : p + 1] = random.choice([[], ["new"], [w[p], "more"]])
            texts.append((10 + 10 * k + j, f"{prose(50)} {' '.join(w)}, {prose(j * 20)}"))
    texts.append((300, items[3][1].upper()))
    table = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([(k, t, 1) for k, t in items], "item_id long, text string, doc_id int")
    got = op5_decontaminate.find_leaks(table, bench).collect()
    found, want = {(r.doc_id, r.item_id) for r in got}, brute_leaks(texts, items)
    assert found <= want and len(found) >= 0.95 * len(want) and {(10 + 10 * k, k) for k in range(7)} <= found and (300, 3) in found
    assert all(r.edits == 0 and r.start == 50 for r in got if r.doc_id % 10 == 0 and 10 <= r.doc_id < 100 and r.doc_id // 10 - 1 == r.item_id)
    assert op5_decontaminate.find_leaks(empty, bench).count() == 0 and op5_decontaminate.find_leaks(docs, bench.limit(0)).count() == 0
    assert op5_decontaminate.drop_contaminated(docs, bench).columns == docs.columns
    rows = spark.createDataFrame([(None, items[3][1], 1), (7, items[3][1], 2), (7, "clean", 3), (None, None, 4), (8, "", 5)], "doc_id long, text string, leaked_ int")
    assert sorted(r.leaked_ for r in op5_decontaminate.drop_contaminated(rows, bench).collect()) == [3, 4, 5]


def test_op5_recall():
    items = [(i, prose(random.randrange(10, 70))) for i in range(60)]
    block = op5_decontaminate.Items([k for k, _ in items], [t.encode() for _, t in items])
    hit = n = 0
    for k, t in items:
        w = t.split()
        for _ in range(int(0.2 * len(w))):
            p = random.randrange(len(w))
            w[p : p + 1] = random.choice([[], ["new"], [w[p], "more"]])
        text = f"{prose(30)} {' '.join(w)} {prose(30)}"
        if (0, k) in brute_leaks([(0, text)], [(k, t)]):
            n += 1
            hit += any(x[1] == k for x in block.search(op5_decontaminate.words_of([text.encode()])))
    assert n > 40 and hit / n >= 0.95


@pytest.mark.parametrize("size", [10, 50, 150, 300])
@pytest.mark.parametrize("before", [0, 100])
def test_op5_recall_of_crowded_edits(size, before):
    """All the edits that are allowed at the front, at the end or at both, in a text that opens with the item or holds it."""
    items = [(i, prose(size + i % 5)) for i in range(20)]
    block = op5_decontaminate.Items([k for k, _ in items], [t.encode() for _, t in items])
    texts = []
    for k, t in items:
        w, m = t.split(), int(0.2 * len(t.split()))
        swapped = ["new" if i < 2 * m and i % 2 else x for i, x in enumerate(w)]
        for left in (w[m:], w[: len(w) - m], w[m // 2 : len(w) - (m - m // 2)], ["new"] * m + w[m:], swapped):
            texts.append((k, " ".join([prose(before), *left, prose(before)])))
    got = {(d, i) for d, i, *_ in block.search(op5_decontaminate.words_of([t.encode() for _, t in texts]))}
    assert sum((j, k) in got for j, (k, _) in enumerate(texts)) >= 0.95 * len(texts)


# 6


def test_op6(spark, docs):
    files = [
        ("a/LICENSE", "Released under the MIT License.", 1), ("a/b/c/x.py", "code", 2), ("a/b/COPYING", "This work is licensed under the GNU General Public License, version 3.", 3),
        ("a/y.py", "# Licensed under the Apache License, Version 2.0.\n" + prose(50), 4), ("a/z.py", None, 5), ("other/q.py", "", 6), (None, "text", 7), ("a/b/c/x.py", "code", 2),
        ("a/bc/n.py", prose(300), 8), ("LICENSE.md", "Licensed under CC BY-NC 4.0.", 9), ("deep/r.txt", prose(900) + "\nLicensed under CC BY 4.0.", 10),
    ]
    got = {r.n: r for r in op6_licenses.scan_licences(spark.createDataFrame(files, "path string, text string, n int")).collect()}
    assert {n: r.licence for n, r in got.items()} == {1: "MIT", 2: "GPL-3.0", 3: "GPL-3.0", 4: "Apache-2.0", 5: "MIT", 6: "CC-BY-NC-4.0", 7: None, 8: "MIT", 9: "CC-BY-NC-4.0", 10: "CC-BY-4.0"}
    clash = spark.createDataFrame([("a/LICENSE", "x", "mine", 7)], "path string, text string, own string, score int")
    row = op6_licenses.scan_licences(clash).first()
    assert (row.own_given, row.score_given, row.own, row.score) == ("mine", 7, None, 0.0)
    assert got[2].inherited_from == "a/b/COPYING" and not got[10].licence_file and got[1].licence_file and got[4].inherited_from is None
    assert op6_licenses.scan_licences(spark.createDataFrame([], "path string, text string")).count() == 0


def test_op6_on_documents(spark, sf):
    import re

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in op6_licenses.op6(spark, sf).collect()}
    files = {}
    for r in sorted(rows.values(), key=lambda r: r.path, reverse=True):
        assert (r.own is not None) == bool(re.search("licensed under|Released under", texts[r.doc_id], re.IGNORECASE)), r
        if r.licence_file:
            files[r.path.rpartition("/")[0]] = r
    for r in rows.values():  # the nearest ancestor's licence, by walking up
        at, want = r.path, None
        while r.own is None and "/" in at and want is None:
            at = at.rpartition("/")[0]
            want = files.get(at)
        assert (r.licence, r.inherited_from) == ((r.own, None) if want is None else (want.own, want.path))


def test_op6_inherits(spark):
    rows = op6_licenses.op6(spark, "/root/testdata/sf0.01").where("inherited_from is not null")
    assert rows.count() > 10


NOTICES = [
    ("MIT", "We left early. Released under the MIT License. The road was dry, and nobody spoke of it again."), ("Apache-2.0", "This article was Licensed under the Apache License, Version 2.0. Read more on our site."),
    ("GPL-3.0", "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version."),
    ("MIT", "// SPDX-License-Identifier: MIT\nint main"), ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without\n modification, are permitted provided that the following conditions are met:"),
    (None, "a licence to drive, version 2.0, under the bridge"), (None, "mit mit isc"), (None, ""), ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991\n" + "more " * 3000),
]


def test_op6_passages():
    model = op6_licenses.Templates()
    for name, text in NOTICES:
        found, score, whole = model.scan(text)
        assert found == name and (score >= 0.8 - 1e-9) == (name is not None), text
        # every window of every template's length, without triggers
        words = op6_licenses._WORD.findall(text.lower())[:200]
        best = max((model.cosine(words[i : i + len(t)], k) for k, t in enumerate(model.words) for i in range(max(1, len(words) - len(t) + 1)) if op6_licenses.TAG not in t), default=0.0)
        assert "SPDX" in text or name is None and text.startswith("mit") or (best >= 0.8 - 1e-9) == (name is not None)
    assert model.scan(NOTICES[-1][1])[2] and not model.scan(NOTICES[0][1])[2]


# 9


@pytest.mark.parametrize("compression", [op9_tiff.NONE, op9_tiff.PACKBITS, op9_tiff.LZW, op9_tiff.DEFLATE])
@pytest.mark.parametrize("predictor", [1, 2])
def test_tiff_round_trip(compression, predictor):
    for n in (64, 640, 64 * 700):
        for body in (b"ab" * (n // 2), bytes(random.randrange(256) for _ in range(n)), (b"a" * 200 + b"xyz") * n):
            pages = op9_tiff.decode(op9_tiff.encode(body[:n], compression, predictor, strip=64, page=300))
            assert b"".join(p.pixels.tobytes() for p in pages) == body[:n] and len(pages) == -(-n // (300 * 64))


def test_tiff_tiles_planes_and_byte_order():
    import struct

    image = np.random.default_rng(2).integers(0, 65536, (20, 35, 2)).astype(np.uint16)
    for order, planes in (("<", 1), (">", 1), (">", 2)):
        tiles = []
        for layer in range(2 if planes == 2 else 1):
            for y in range(0, 20, 16):
                for x in range(0, 35, 16):
                    block = np.zeros((16, 16, 2 if planes == 1 else 1), np.uint16)
                    part = image[y : y + 16, x : x + 16] if planes == 1 else image[y : y + 16, x : x + 16, layer : layer + 1]
                    block[: part.shape[0], : part.shape[1]] = part
                    diff = np.diff(block, axis=1, prepend=np.zeros((16, 1, block.shape[2]), np.uint16)).astype(np.uint16)
                    tiles.append(zlib.compress(diff.astype(order + "u2").tobytes()))
        out = bytearray({"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HI", 42, 0))
        offsets = []
        for t in tiles:
            offsets.append(len(out))
            out += t
        arrays = {324: offsets, 325: [len(t) for t in tiles]}
        places = {}
        for tag, values in arrays.items():
            places[tag] = len(out)
            out += struct.pack(f"{order}{len(values)}I", *values)
        struct.pack_into(order + "I", out, 4, len(out))
        short = {256: 35, 257: 20, 259: 8, 277: 2, 284: planes, 317: 2, 322: 16, 323: 16}
        entries = [struct.pack(order + "HHIHH", tag, 3, 1, v, 0) for tag, v in short.items()] + [struct.pack(order + "HHIHH", 258, 3, 2, 16, 16)]
        entries += [struct.pack(order + "HHII", tag, 4, len(v), places[tag]) for tag, v in arrays.items()]
        out += struct.pack(order + "H", len(entries)) + b"".join(entries) + b"\0\0\0\0"
        (page,) = op9_tiff.decode(bytes(out))
        assert (page.pixels == image).all()


def test_op9(docs, empty, spark):
    rows = op9_tiff.digest_media(op9_tiff.store_texts(docs)).collect()
    assert len(rows) == docs.count()
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, set()).add((r.text or "").encode())
    for r in rows:
        wants = [t + b"\0" * (64 - len(t) if not t else -len(t) % 64) for t in texts[r.doc_id]]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) in {(len(w), hashlib.sha256(w).hexdigest(), zlib.crc32(w[-64:])) for w in wants}
    assert op9_tiff.digest_media(op9_tiff.store_texts(empty)).count() == 0
    media = [("a", op9_tiff.encode(b"x" * 640, page=4)), ("b", None), ("c", b"II*\0junk"), ("d", b""), ("a", b"MM")]
    pages = op9_tiff.read_tiff(spark.createDataFrame(media, "name string, media binary"), "media", "name").collect()
    assert [(r.page, r.height) for r in pages if r.name == "a" and r.page >= 0] == [(0, 4), (1, 4), (2, 2)]
    assert len([r for r in pages if r.page == -1 and r.error]) == 4


def test_broken_tiff():
    import struct

    draw, caught = random.Random(4), 0
    for form in op9_tiff.FORMS:
        whole = op9_tiff.encode(prose(20).encode().ljust(192, b"."), form[0], form[1], tiled=form[2])
        for _ in range(120):
            media = bytearray(whole[: draw.choice([len(whole), draw.randrange(len(whole))])])
            for _ in range(draw.randrange(1, 5)):
                if media:
                    media[draw.randrange(len(media))] = draw.choice([0, 1, 255, draw.randrange(256)])
            try:
                op9_tiff.decode(bytes(media))
            except (ValueError, struct.error, zlib.error, LookupError, ArithmeticError):
                caught += 1
    assert caught > 500
    for tag, value in ((256, 2**32 - 1), (257, 2**32 - 1), (256, 0), (278, 0), (277, 0), (273, 2**31)):
        media = bytearray(op9_tiff.encode(b"x" * 640))
        place = media.index(struct.pack("<HHI", tag, 4, 1)) + 8
        struct.pack_into("<I", media, place, value)
        with pytest.raises(op9_tiff.TiffError):
            op9_tiff.decode(bytes(media))


def test_forms_are_all_stored(spark, sf):
    texts = [r.text.encode() for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    assert {op9_tiff.form_of(op9_tiff.padded(t)) for t in texts} == set(op9_tiff.FORMS)


# 10


def test_op10(docs, empty):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path(op10_tokens.MODEL)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    odd = ["", " ", "  a  ", "▁x y▁ z", "<s> <unk> <0x41>\n\t x　y", "a" * 700, "日本語 😀 \x00 z", "0 1  2   3"] + [t for t in TEXTS if t]
    own = op10_tokens.Counter(path)
    assert own.splits and [own.count(t) for t in odd] == [len(library.encode(t)) for t in odd]
    rows = op10_tokens.count_tokens(docs, path, 400).collect()
    want = sorted((str(r.doc_id), len((r.text or "").encode()), len(library.encode(r.text or ""))) for r in docs.collect())
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in rows) == want and all(r.over_limit == (r.n_tokens > 400) for r in rows)
    assert op10_tokens.count_tokens(empty, path).count() == 0


def test_op7_messages_by_slice():
    """A group sends one message to a slice, however many shards the slice has: rows grow with groups x slices alone."""
    draw = random.Random(3)
    texts = ["".join(draw.choice("abcdefgh ") for _ in range(3000)) for _ in range(20)]
    group = pa.table({"doc_id": pa.array(range(40), pa.int64()), "text": pa.array(texts + texts), "g": pa.array([5] * 40, pa.int32())})
    runs = op7_suffix.Runs(op7_suffix.ex.Group(group), 100)
    at = op7_suffix.ex.cuts(runs.distinct, 3, op7_suffix.ex.FILTER_BITS)
    all_twice = op7_suffix.ex.answers([(5, r, kind, op7_suffix.ex.bits_of(np.full(b - a, kind == 1))) for r, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) for kind in (1, 2)])
    sent = op7_suffix._region_messages(3, 24, 100)(group, all_twice)
    assert sent.num_rows == 3 and sent.column("r").to_pylist() == [0, 1, 2]
    gone = [body for r in range(3) for body in op7_suffix._slice(100)(sent.slice(r, 1)).column("body").to_pylist()]
    removed = op7_suffix._removed(op7_suffix.ex.Group(group), pa.table({"body": pa.array(gone, pa.binary())}))
    assert removed == [[]] * 20 + [[(0, 3000)]] * 20
