"""Every operator against brute force, an exact round trip, planted cases or held-out rows."""

import collections
import io
import itertools
import random
import zipfile
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import common, decontaminate, exact_dedup, language_id, license_scan, line_dedup, near_dedup, packing, quality, queries, toxicity, warc_zip

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return common.table(spark, SF, "documents")


def sql(name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    found = con.execute(queries.oracle_sql()[name])
    return sorted((tuple(r) for r in found.fetchall()), key=str), [c[0] for c in found.description]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    want, columns = sql(name)
    assert sorted((tuple(r) for r in queries.queries()[name](spark, SF).select(*columns).collect()), key=str) == want


# ---------------------------------------------------------------- packing
def test_ids_are_the_tokenizer_s(spark, documents):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    texts = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    pieces = collections.defaultdict(list)
    rows = packing.pack_documents(documents).collect()
    for r in rows:
        pieces[r["doc_id"]].append(r)
    for doc_id, text in texts.items():
        want = t.encode(text, add_special_tokens=False).ids + [2]
        own = sorted(pieces[doc_id], key=lambda r: r["start"])
        assert [r["start"] for r in own] == [0, *itertools.accumulate(r["length"] for r in own)][:-1]
        assert np.concatenate([np.frombuffer(r["ids"], "<u4") for r in own]).tolist() == want
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"], r["sequence_length"]))
    for own in sequences.values():
        own.sort()
        total = sum(n for _, n, _ in own)
        assert [o for o, *_ in own] == [0, *itertools.accumulate(n for _, n, _ in own)][:-1]
        assert total == own[0][2] <= 4096 and total & total - 1 == 0  # nothing is padded


@pytest.mark.parametrize("text", ["", "a\x1cb", "Ünïcödé É²½ ªº µ ×÷", "<|endoftext|>x <|startoftext|>", "don't I'LL we've", "中文 テスト é́ x", "İstanbul ΣΑΣ", "a\xa0b\x85c", "12ab#$%...!!", "ß\xad\xff\xf7q", "'sx 'S"])
def test_odd_texts(text):
    e = packing.encoder(packing.default_tokenizer())
    assert list(e(text)) == e.tokenizer.encode(text, add_special_tokens=False).ids


def test_costs_are_balanced():
    rng = random.Random(1)
    pieces = [(k, 0, rng.randint(1, 3000)) for k in range(600)]
    spent = collections.Counter()
    for _, _, n, s, _ in packing.pack(pieces):
        spent[s] += packing.cost(n)
    full = [spent[s] for s, c in enumerate(packing.capacities(sum(p[2] for p in pieces))) if c == 4096]
    assert max(full) < 1.6 * min(full)


def test_every_block_is_balanced(spark, documents):
    """Blocks of 8 sequences: the costs of full sequences of one block, and the powers of two at a task's end."""
    texts = documents.where("length(text) < 6000").select("doc_id", "text").coalesce(2)
    rows = packing.pack_documents(texts, block_sequences=8).collect()
    spent, size = collections.Counter(), {}
    for r in rows:
        spent[r["sequence_id"]] += packing.cost(r["length"])
        size[r["sequence_id"]] = r["sequence_length"]
    by_task = collections.defaultdict(list)
    for k in sorted(size):
        by_task[k >> 32].append(k)
    for own in by_task.values():
        full = [k for k in own if size[k] == 4096]
        assert [size[k] for k in own[len(full) :]] == sorted({size[k] for k in own[len(full) :]}, reverse=True)  # distinct powers of two
        whole = [full[i : i + 8] for i in range(0, len(full) - len(full) % 8, 8)]
        assert whole and all(max(spent[k] for k in block) < 2 * min(spent[k] for k in block) for block in whole)


def test_packing_null_ids_and_repeated_rows(spark):
    rows = [(None, "some words"), (7, "some words"), (7, "some words"), (8, None)]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert sorted((r["doc_id"] or -1, r["doc_tokens"]) for r in got if r["start"] == 0) == [(-1, 3), (7, 3), (7, 3), (8, 1)] and sum(r["length"] for r in got) == 10


# ---------------------------------------------------------------- near duplicates
def brute_components(texts, k, percent=80):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(zip(*(w[j:] for j in range(k)))) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = collections.defaultdict(list)
    for i in sorted(sets):
        seen = collections.Counter(j for s in sets[i] for j in holders[s])
        for j, both in seen.items():
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
        for s in sets[i]:
            holders[s].append(i)
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(documents, k):
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.components(documents, k).collect()}
    assert got == brute_components(texts, k)


def test_a_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "HELD", 500)  # buckets pass in several pieces
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base, shared = [word() for _ in range(60)], [word() for _ in range(15)]
    texts = {}
    for i in range(300):
        own = list(base)
        own[rng.randrange(60)] = word()
        texts[i] = " ".join(own)
    for i in range(300, 600):  # a passage in common, and nothing else
        texts[i] = " ".join(shared + [word() for _ in range(20)])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.components(df, 2).collect()}
    assert got == {i: c for i, (_, c) in brute_components(texts, 2).items()}


def test_links_that_leaders_hide(spark):
    """Copies with one change link with those with two (0.815), which do not link with each other (0.76)."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base, texts = [word() for _ in range(60)], {}
    for i in range(250):
        own = list(base)
        for at in rng.sample(range(2, 58, 3), 1 if i > 230 else 2):
            own[at] = word()
        texts[i] = " ".join(own)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    want = {i: c for i, (_, c) in brute_components(texts, 2).items()}
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.components(df, 2).collect()} == want and set(want.values()) == {0}


def test_bitmaps_bound_differences():
    """Bits that differ are at most the shingles that differ, whatever the sizes; and they are near them."""
    rng = np.random.default_rng(4)
    for _ in range(60):
        n, m, both = rng.integers(0, 700), rng.integers(0, 700), rng.integers(0, 900)
        flat = np.unique(rng.integers(0, 2**63, n + m + both, dtype=np.uint64))
        a, b = flat[: both + n], np.concatenate([flat[:both], flat[both + n :]])
        sets = near_dedup.parities(np.concatenate([a, b]), np.array([len(a), len(b)]))
        x, y = (np.frombuffer(s, np.uint64)[None] for s in sets)
        width = min(x.shape[1], y.shape[1])
        differ = int(np.bitwise_count(near_dedup.folded(x, width) ^ near_dedup.folded(y, width)).sum())
        true = len(np.setxor1d(a, b))
        assert differ <= true and (true > 0.3 * (len(a) + len(b)) or differ >= 0.75 * true - 5)


def test_a_group_around_one_text(spark):
    """Copies with 4 to 7 changes around one text: some link with it, hardly any with each other; and a chain through another."""
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base, texts = [word() for _ in range(100)], {}
    for i in range(400):
        own = list(base)
        for at in rng.sample(range(2, 98, 3), rng.choice((4, 5, 6, 7))):
            own[at] = word()
        texts[i] = " ".join(own)
    texts[400] = " ".join(base)
    other = list(base)
    for k in range(401, 480):  # each link of a chain changes two words more
        for at in rng.sample(range(100), 2):
            other[at] = word()
        texts[k] = " ".join(other)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    want = {i: c for i, (_, c) in brute_components(texts, 2).items()}
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.components(df, 2).collect()} == want and 1 < len(set(want.values())) < 400


def test_tensored_keys_find_borderline_pairs():
    """Recall of shared keys and of likely pairs at similarity 0.8, against its formula."""
    rng = np.random.default_rng(5)
    hit = 0
    for _ in range(300):
        both, a, b = rng.integers(0, 2**63, 160, dtype=np.uint64), *rng.integers(0, 2**63, (2, 20), dtype=np.uint64)
        mins = [(np.concatenate([both, x])[:, None] * near_dedup.MULTIPLY + near_dedup.ADD).min(0).reshape(2, near_dedup.TABLES, -1) for x in (a, b)]
        hit += all((mins[0][c] == mins[1][c]).all(1).any() for c in (0, 1))
    assert hit >= 295


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 200), (300, 200)], "u long, v long")
    got = {r["node"]: r["component"] for r in common.connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100, 300: 100}


# ---------------------------------------------------------------- exact duplicates
def test_directory_doubles_until_buckets_fit(spark):
    found = spark.range(3000).select(F.xxhash64("id").alias("hash"))
    slots, depth = exact_dedup.directory(found, capacity=64)
    per = found.withColumn("slot", exact_dedup.slot_of(depth)).join(slots, "slot").groupBy("bucket").count().collect()
    assert sum(r["count"] for r in per) == 3000 and max(r["count"] for r in per) <= 64 and len(per) > 40


def test_directory_doubles_beyond_the_first_guess(spark):
    """Hashes that differ in low bits alone make one bucket overfull until those bits count; equal hashes stay together."""
    close = spark.range(300).select((F.col("id") * 1024 + (1 << 40)).alias("hash"))
    found = close.union(spark.range(200).select(F.lit(5).cast("long").alias("hash")))
    slots, depth = exact_dedup.directory(found, capacity=64)
    per = exact_dedup.in_bucket(found, slots, depth).groupBy("bucket").agg(F.count("hash").alias("n"), F.countDistinct("hash").alias("d")).collect()
    assert sum(r["n"] for r in per) == 500 and all(r["n"] <= 64 or r["d"] == 1 for r in per)
    with_slots = found.withColumn("slot", exact_dedup.slot_of(depth))
    assert with_slots.join(slots, "slot").where(F.col("bucket") > F.col("slot")).count() == 0


# ---------------------------------------------------------------- lines
def test_patience_keeps_order_and_blocks():
    a, b = [1, 2, 3, 9, 4, 5], [7, 1, 2, 3, 4, 5, 8]
    assert line_dedup.patience(a, b) == [(0, 1), (1, 2), (2, 3), (4, 4), (5, 5)]
    assert [len(x) for x in line_dedup.blocks(line_dedup.patience(a, b))] == [3, 2]


def test_repeated_lines_go_from_later_documents(spark):
    lines = [f"a line number {k} of the shared passage here" for k in range(5)]
    rows = [(1, "\n".join(["first own line of text in one", *lines])), (2, "\n".join([*lines[:3], "own words of the second document", lines[4]])), (3, "short\nown words of the third document\nshort"), (4, lines[0])]
    out = {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_dedup.remove_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: (rows[0][1], 0), 2: ("own words of the second document", 4), 3: (rows[2][1], 0), 4: ("", 1)}


def test_no_key_line_stays_that_an_earlier_document_holds(spark):
    """Lines in another order, and lines that stand twice in the first holder or in the later document."""
    a, b, c = (f"a line number {k} of the shared passage here" for k in range(3))
    rows = [(1, "\n".join(["own words of the first document", a, "x", b, "own end of the first document", c, "y", "again words of the first document", c])), (2, "\n".join([b, "own words of the second document", a, "x"])), (3, "\n".join(["own words of the third document", a, "third own line of the document", c, "y", "third end line of the document", a]))]
    out = {r["doc_id"]: r["text"] for r in line_dedup.remove_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: rows[0][1], 2: "own words of the second document", 3: "own words of the third document\nthird own line of the document\nthird end line of the document"}


def test_lines_in_another_order_go_from_every_copy(spark):
    a, b = (f"a line number {k} of the shared passage here" for k in range(2))
    rows = [(1, f"{a}\n{b}"), (2, f"{b}\n{a}"), (3, f"{b}\n{a}")]
    out = {r["doc_id"]: r["text"] for r in line_dedup.remove_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: rows[0][1], 2: "", 3: ""}


def test_lines_by_all_pairs(documents):
    """Against an alignment with every earlier document that shares a key: no key line is missed, nothing else goes."""
    import xxhash

    texts = {r["doc_id"]: r["text"] for r in documents.collect() if r["text"] is not None}
    hashes, keys, holders = {}, {}, collections.defaultdict(list)
    for i in sorted(texts):
        own = [x.strip() for x in texts[i].encode().split(b"\n")]
        hashes[i] = [xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in own]
        keys[i] = {h for x, h in zip(own, hashes[i]) if line_dedup.is_key(x)}
        for k in keys[i]:
            holders[k].append(i)
    want = {}
    for i in sorted(texts):
        gone = set()
        for j in {j for k in keys[i] for j in holders[k] if j < i}:
            part = {q for run in line_dedup.blocks(line_dedup.patience(hashes[j], hashes[i])) if any(hashes[i][q] in keys[i] for _, q in run) for _, q in run}
            gone |= part | line_dedup.left_over(hashes[j], hashes[i], keys[i], part)
        want[i] = gone
    got = {r["doc_id"]: set(r["removed"]) for r in line_dedup.repeated(documents).collect()}
    missed = [(i, q) for i in want for q in want[i] - got.get(i, set())]
    assert all(got[i] <= want[i] for i in got) and sum(map(len, want.values())) > 1000
    assert len(missed) <= 3 and not any(hashes[i][q] in keys[i] for i, q in missed)


@pytest.mark.parametrize("line", ["own\twords\tby\ttabs\there", "no\u00a0break\u00a0spaces\u00a0stand\u00a0here", "これは空白のない長い行です", "นี่คือบรรทัดยาวที่ไม่มีช่องว่าง", "x" * 40])
def test_long_lines_without_plain_spaces_are_keys(spark, line):
    rows = [(1, f"first\n{line}"), (2, f"{line}\nsecond"), (3, "short\tline"), (4, "short\tline")]
    out = {r["doc_id"]: r["text"] for r in line_dedup.remove_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: rows[0][1], 2: "second", 3: rows[2][1], 4: rows[3][1]}


@pytest.mark.parametrize("seed", range(20))
def test_left_over_by_brute_force(seed):
    rng = random.Random(seed)
    a, b = ([rng.randrange(12) for _ in range(rng.randrange(30))] for _ in range(2))
    keys, want = set(range(6)), set()
    for p, q in itertools.product(range(len(a)), range(len(b))):
        n = next((n for n in range(len(b)) if p + n >= len(a) or q + n >= len(b) or a[p + n] != b[q + n]), len(b))
        if any(x in keys for x in b[q : q + n]):
            want.update(range(q, q + n))
    assert line_dedup.left_over(a, b, keys, set()) == want


# ---------------------------------------------------------------- archives
def test_zip_directories():
    for wide in (False, True):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            for name, body in ((warc_zip.DATA, b"x" * 100), (warc_zip.INDEX, b"0 3 1\n")):
                with z.open(zipfile.ZipInfo(name), "w", force_zip64=wide) as m:
                    m.write(body)
            z.comment = b"a comment"
        members = warc_zip.directory(out, len(out.getvalue()))
        m = warc_zip.stored(members, warc_zip.INDEX)
        assert out.getvalue()[m.start : m.start + m.size] == b"0 3 1\n"


def test_zip64_end_record():
    """An archive whose end record refers to the ZIP64 one."""
    import struct

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(warc_zip.DATA, b"abc")
    plain = out.getvalue()
    end = plain.rfind(b"PK\x05\x06")
    length, offset = struct.unpack("<II", plain[end + 12 : end + 20])
    big = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, length, offset)
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, end, 1)
    wide = plain[:end] + big + locator + struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    [m] = warc_zip.directory(io.BytesIO(wide), len(wide))
    assert wide[m.start : m.start + m.size] == b"abc"


def test_payloads_come_back_whole(spark):
    pages = common.table(spark, SF, "pages")
    want = {r["page_id"]: (r["html"] or "").encode() for r in pages.collect()}
    back = warc_zip.read(warc_zip.write(pages, common.new_path(spark, "warc-test")), payloads=True).collect()
    assert len(back) == len(want) and all(r["payload"] is None or bytes(r["payload"]) == want[r["page_id"]] for r in back)


def test_small_and_long_payloads_in_many_packages(spark, monkeypatch):
    monkeypatch.setattr(warc_zip, "PACKAGE_BYTES", 5_000)
    monkeypatch.setattr(warc_zip, "READ_BYTES", 700)
    long = "<p>é\r\n\r\n</p>" * 40_000
    rows = [(k, f"u{k}", body) for k, body in enumerate(["ab", "ab", "abcd", "abcd", long, long, "", None] + [f"<p>{k}</p>" * 30 for k in range(60)])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    manifest = warc_zip.write(pages, common.new_path(spark, "warc-test"), min_bytes=3)
    got = {r["page_id"]: r for r in warc_zip.read(manifest, payloads=True).collect()}
    assert manifest.count() > 6 and len(got) == len(rows)
    kind = lambda k: (got[k]["record_type"], got[k]["refers_to"])
    assert [kind(k) for k in range(8)] == [("response", None)] * 3 + [("revisit", 2), ("response", None), ("revisit", 4), ("response", None), ("response", None)]
    assert all((got[k]["payload"] is None) == (k in (3, 5)) and (got[k]["payload"] is None or bytes(got[k]["payload"]) == (body or "").encode()) for k, _, body in rows)
    assert got[5]["payload_bytes"] == len(long.encode()) and got[5]["payload_digest"] == warc_zip.digest(long.encode())


# ---------------------------------------------------------------- decontamination
def test_bit_parallel_subsequence():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(1, 14))] for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, j in itertools.product(range(len(a)), range(len(b))):
            table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        got = decontaminate.lcs(a, b)
        own = iter(b)
        assert len(got) == table[-1, -1] and all(a[k] in own for k in got)


def test_planted_and_paraphrased_items_are_found(spark, documents):
    benchmark = common.table(spark, SF, "benchmark")
    items = {r["item_id"]: r["text"] for r in benchmark.collect()}
    clean = [r for r in documents.where("doc_id < 300").select("doc_id", "text").collect()]
    rng = random.Random(4)
    planted = []
    for k, (item, text) in enumerate(sorted(items.items())):
        own = text.split()
        for _ in range(max(1, len(own) // 10)):
            own[rng.randrange(len(own))] = f"other{rng.randrange(10**6)}"
        host = clean[k]["text"].split()
        planted.append((10_000 + k, " ".join([*host[:40], *own, *host[40:]])))
    df = spark.createDataFrame([tuple(r) for r in clean] + planted, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(df, benchmark).collect()}
    missed = [(10_000 + k, i) for k, i in enumerate(sorted(items)) if (10_000 + k, i) not in got]
    whole = lambda t: b" ".join(decontaminate.words(t)).decode()
    exact = {(r["doc_id"], i) for r in clean for i, t in items.items() if f" {whole(t)} " in f" {whole(r['text'] or '')} "}
    assert len(missed) <= 1 and exact <= got
    hosts = {10_000 + k: clean[k]["doc_id"] for k in range(len(items))}
    assert {(d, i) for d, i in got if d < 10_000} == exact and all(i == sorted(items)[d - 10_000] or (hosts[d], i) in exact for d, i in got if d >= 10_000)


def test_items_whose_leaks_are_copied_often(spark, documents):
    """A leaking document copied into a third of all rows makes its own words frequent."""
    items = {r["item_id"]: r["text"] for r in common.table(spark, SF, "benchmark").collect()}
    clean = [tuple(r) for r in documents.where("doc_id < 300").select("doc_id", "text").collect()]
    item = max(items, key=lambda i: len(items[i]))
    host = clean[0][1].split()[:120]
    copies = [(10_000 + k, " ".join([*host[:60], items[item], *host[60:]])) for k in range(1_500)]
    others = [(20_000 + k, " ".join([*clean[k][1].split()[:50], items[item]])) for k in range(1, 6)]
    df = spark.createDataFrame([*clean, *copies, *others], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["cosine"] for r in decontaminate.matches(df, common.table(spark, SF, "benchmark")).where(F.col("item_id") == item).collect()}
    assert {i for i, _ in copies + others} <= set(got) and min(got[i] for i, _ in copies + others) > 0.3


def test_paraphrases_without_cosine_are_found(spark, documents, monkeypatch):
    """Passages that keep 54 to 100 % of an item's words, the last ones among them, at any place of a document."""
    monkeypatch.setattr(decontaminate, "COSINE", 2.0)  # all rank below it
    items = {r["item_id"]: r["text"].split() for r in common.table(spark, SF, "benchmark").collect()}
    hosts = [r["text"].split() for r in documents.where("doc_id < 300").collect() if r["text"]]
    rng, rows, want = random.Random(6), [], set()
    for keep, (item, words) in itertools.product((1.0, 0.8, 0.65, 0.54), sorted(items.items())):
        for _ in range(5):
            own, host = list(words), rng.choice(hosts)
            for at in rng.sample(range(len(own) - decontaminate.ANSWER), min(len(own) - decontaminate.ANSWER, int(len(own) * (1 - keep)))):
                own[at] = rng.choice(rng.choice(hosts))
            at = rng.randrange(len(host) + 1)
            want.add((len(rows), item))
            rows.append((len(rows), " ".join([*host[:at], *own, *host[at:]])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(df, common.table(spark, SF, "benchmark")).collect()}
    assert want <= got


def brute_matches(text, item):
    """Whether the rule holds for the item and some stretch of the text, by subsequences over all stretches."""
    own, target = decontaminate.words(text), decontaminate.words(item)
    answer, best = min(decontaminate.ANSWER, len(target)), False
    for begin in range(0, max(1, len(own)), 4):
        near = own[begin : begin + 2 * len(target) + decontaminate.WINDOW]
        found = decontaminate.lcs(target, near)
        cover, last = len(found) / len(target), sum(k >= len(target) - answer for k in found) / answer
        best |= cover >= decontaminate.COVER
        near = own[begin : begin + 2 * len(target)]
        found = decontaminate.lcs(target, near)
        cover, last = len(found) / len(target), sum(k >= len(target) - answer for k in found) / answer
        best |= cover >= decontaminate.COVER_ANSWER and last >= decontaminate.ANSWER_COVER
    return best


def test_every_match_by_exhaustive_subsequences(spark, documents):
    """All pairs of 150 documents, 60 of them with paraphrased items, and 30 items: what holds by brute force is found."""
    items = [(r["item_id"], r["text"]) for r in common.table(spark, SF, "benchmark").collect() if r["text"]][:30]
    rows = [(r["doc_id"], " ".join(r["text"].split()[:300])) for r in documents.where("doc_id < 150 and text is not null").collect()]
    rng = random.Random(8)
    for n in range(60):
        own = items[n % 30][1].split()
        for at in rng.sample(range(len(own)), int(len(own) * rng.choice((0.2, 0.3, 0.35)))):
            own[at] = rng.choice(rng.choice(rows)[1].split() or ["x"])
        host = rows[n][1].split()
        rows[n] = (rows[n][0], " ".join([*host[:50], *own, *host[50:]]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(df, benchmark).collect()}
    want = {(d, i) for d, t in rows for i, x in items if brute_matches(t, x)}
    assert len(want) >= 50 and want <= got
    assert all(decontaminate.lcs(decontaminate.words(dict(items)[i]), decontaminate.words(dict(rows)[d])) for d, i in got)
    assert len(got - want) <= 0.05 * len(want)  # stretches that the brute force steps over


def test_blocks_of_items_find_what_one_finds(spark, documents, monkeypatch):
    benchmark, docs = common.table(spark, SF, "benchmark"), documents.where("doc_id < 400")
    find = lambda: {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs, benchmark).collect()}
    want = find()
    n = benchmark.count()
    assert all(len(b.ids) * len(b.terms) <= 20_000 or len(b.ids) == 1 for b in decontaminate.item_blocks(benchmark, 1000, 20_000))
    monkeypatch.setattr(decontaminate, "item_blocks", lambda b, f=decontaminate.item_blocks: f(b, -(-n // 3), 10**9))
    assert len(list(decontaminate.item_blocks(benchmark))) >= 3 and find() == want != set()


def test_screen_leaves_no_window_out():
    """Every window whose surroundings hold enough of an item's words as a bag, against a count of all."""
    rng = np.random.default_rng(3)
    targets = [rng.integers(0, 40, n).astype(np.int32) for n in (1, 15, 16, 17, 40)]
    size = np.array([0, 5, 16, 33, 200])
    every = np.where(rng.random(size.sum()) < 0.5, rng.integers(0, 40, size.sum()), -1).astype(np.int32)
    got = set(zip(*(x.tolist() for x in decontaminate.screen(targets, np.arange(40)[::-1]).windows(every, size))))
    half, number = decontaminate.WINDOW // 2, 0
    for begin, n in zip(np.cumsum(size) - size, size):
        own = every[begin : begin + n]
        for place in range(0, n, half):
            for i, t in enumerate(targets):
                near = collections.Counter(own[max(0, place - len(t)) : place + 2 * half + len(t)].tolist())
                assert sum((near & collections.Counter(t.tolist())).values()) < decontaminate.COVER_ANSWER * len(t) or (i, number) in got
            number += 1


# ---------------------------------------------------------------- licences
def test_base_places_by_regular_expression(documents):
    import re

    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    got = {r["doc_id"]: r for r in license_scan.scan(documents).collect()}
    for row in documents.collect():
        own = word.findall((row["text"] or "").translate(lower))
        places = [(k, label) for p, label in license_scan.BASE.items() for k in range(len(own)) if own[k : k + len(p.split())] == p.split()]
        r = got[row["doc_id"]]
        assert (r["n_words"], r["n_base"]) == (len(own), len(places))
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places})) and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert ("cc-by-nc" in r["labels"].split(",")) == ("Licensed under CC BY-NC 4.0" in (row["text"] or ""))


@pytest.mark.parametrize("label, text, phrases", license_scan.TEMPLATES)
def test_whole_texts_with_names_and_changes(label, text, phrases):
    """Every template between other words: as it is, with words put in, and with a tenth of its other words replaced."""
    rng = random.Random(len(text))
    filler = [f"filler{k}" for k in range(60)]
    index = license_scan.Index(license_scan.TEMPLATES, 1000, {w: 40 for w in license_scan.split("the of and software this license copyright in any")})
    fixed = {w for p in phrases for w in license_scan.split(p)}
    own = [w.decode() for w in license_scan.split(text)]
    put = list(own)
    if len(own) > 30:
        put[len(own) // 2 : len(own) // 2] = ["copyright", "2024", "some", "company"]
    changed = [w if w.encode() in fixed or rng.random() > 0.1 else "changed" for w in own]
    for body in (own, put, changed):
        found = index.scan(license_scan.split(" ".join([*filler, *body, *filler])))
        spans = [s for s in found if s[0] == label]
        assert spans and max(s[3] for s in spans) > 0.7 and any(abs(s[1] - 60) <= license_scan.DRIFT for s in spans)
    part = index.scan(license_scan.split(" ".join(filler + own[: max(1, len(own) // 8)])))
    assert all(s[2] != len(own) for s in part) or len(own) < 30  # at most a notice that stands in the beginning


def test_licences_by_all_places(documents):
    """Templates against every place of every document: wherever enough weight agrees without shifts, the span is found."""
    docs = [(r["doc_id"], license_scan.words((r["text"] or "").encode())) for r in documents.where("doc_id < 500").collect()]
    vocabulary = {w for _, t, _ in license_scan.TEMPLATES for w in license_scan.split(t)}
    df = collections.Counter(w for _, own in docs for w in vocabulary.intersection(own))
    index = license_scan.Index(license_scan.TEMPLATES, len(docs), df)
    n = 0
    for _, own in docs:
        found = index.scan(own)
        for t, (label, text, phrases) in enumerate(index.templates):
            places = collections.defaultdict(list)
            for q, w in enumerate(text):
                places[w].append(q)
            agree = collections.Counter()
            for p, w in enumerate(own):
                for q in places.get(w, ()):
                    agree[p - q] += index.idf[w]
            for at, weight in agree.items():
                if weight >= license_scan.AGREE * index.weight[t] and all(license_scan._holds(own[max(0, at) : at + len(text)], p) for p in phrases):
                    n += 1
                    assert any(s[0] == label and abs(s[1] - max(0, at)) <= license_scan.DRIFT for s in found)
    assert n >= 5


# ---------------------------------------------------------------- classifiers
@pytest.mark.parametrize("name, label, n, hold, least", [("op6_quality", "quality", 4, 2, 0.95), ("op1_toxicity", "toxic", 3, 1, 0.95)])
def test_held_out_accuracy(spark, name, label, n, hold, least):
    big = "/root/testdata/sf0.1"
    rows = queries.queries()[name](spark, big).join(common.table(spark, big, "labels"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % n == hold) for r in rows)
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r[label] == r["predicted"] for r in held]) >= least


def test_languages(spark):
    rows = queries.op3_language_id(spark, SF).join(common.table(spark, SF, "documents"), "doc_id").where("held_out and lang is not null").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) >= 0.99


def test_toxicity_scores_by_hand(spark, documents):
    """A fitted model's scores are its weights summed over a text's distinct n-grams, each hashed by itself."""
    labels = common.table(spark, SF, "labels")
    model = toxicity.train(documents, labels, F.lit(True))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(documents, model).collect()}
    for r in documents.where("doc_id < 60").collect():
        ids = set()
        for w in set((r["text"] or "").split()):
            ids.update(int(x) for x in toxicity.ngrams([w])[0])
        z = model.bias + sum(model.weight[i] for i in ids)
        assert np.isclose(got[r["doc_id"]], 1 / (1 + np.exp(-z)), atol=1e-9)


def test_log_count_ratio_scales_features():
    """One feature only in toxic texts, one only in clean ones, one in all: signs and weights follow the ratios."""
    label = np.array([1] * 20 + [0] * 20)
    rows = [[1, 3]] * 20 + [[2, 3]] * 20
    model = toxicity.fit(label, np.array([2] * 40), np.concatenate(rows).astype(np.int32))
    assert model.weight[1] > 0 > model.weight[2] and model.weight[3] == 0
    assert np.isclose(toxicity.log_ratio(20, 0, 20, 20), np.log(21 / 22) - np.log(1 / 22))


def test_language_scores_by_hand(spark):
    """Word first, then the longest n-grams that are known, against a plain count."""
    import math

    rows = [(1, "the cat sat", "en"), (2, "the dog ran the", "en"), (3, "le chat dort", "fr"), (4, "le chien le", "fr")]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    texts = ["the cat", "le thé", "catx", "zzz", "chatte ran", "qqq lle"]
    counts = {o: {k: collections.Counter() for k in ("en", "fr")} for o in (0, *language_id.ORDERS)}
    for _, text, lang in rows:
        for w in text.split():
            counts[0][lang][w] += 1
            for o in language_id.ORDERS:
                counts[o][lang].update(language_id.grams(w, o))
    known = {o: set(counts[o]["en"]) | set(counts[o]["fr"]) for o in counts}
    log = lambda o, lang, g: math.log((counts[o][lang][g] + language_id.SMOOTH) / (sum(counts[o][lang].values()) + language_id.SMOOTH * len(known[o])))

    def word(w, lang):
        if w in known[0]:
            return log(0, lang, w)
        for o in language_id.ORDERS:
            some = [g for g in language_id.grams(w, o) if g in known[o]]
            if some:
                return sum(log(o, lang, g) for g in some) / len(some)
        return 0.0

    got = {r["doc_id"]: r for r in language_id.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, text in enumerate(texts):
        z = {lang: sum(word(w, lang) for w in text.split()) for lang in ("en", "fr")}
        best = max(sorted(z), key=z.get)
        assert got[i]["lang_pred"] == best and np.isclose(got[i]["score"], math.exp(z[best]) / sum(map(math.exp, z.values())), atol=1e-5)


def test_language_ties_go_to_the_first_name(spark):
    same = spark.createDataFrame([(1, "abc", "xx"), (2, "abc", "aa")], "doc_id long, text string, lang string")
    assert [tuple(r)[1:] for r in language_id.predict(same.limit(1), language_id.train(same, F.lit(True))).collect()] == [("aa", 0.5)]


def test_factorisation_identity():
    rng = np.random.default_rng(1)
    width = (1 << quality.BITS) + quality.STATS
    m = quality.Model(rng.normal(size=width), rng.normal(size=(width, quality.FACTORS)), 0.3, np.zeros(quality.STATS), np.ones(quality.STATS))
    ids, stats = np.array([5, 9, 77], np.int32), rng.normal(size=(1, quality.STATS))
    x = np.zeros(width)
    x[ids], x[1 << quality.BITS :] = 1 / np.sqrt(3), m.dense(stats)[0]
    used = np.flatnonzero(x)
    pairs = sum(m.v[i] @ m.v[j] * x[i] * x[j] for i, j in itertools.combinations(used, 2))
    assert np.isclose(m.margins([ids], stats)[0], 0.3 + m.w @ x + pairs)


def test_ngrams_by_slices():
    words = ["Héllo", "a-b", "", "x" * 9]
    flat, size = toxicity.ngrams(words)
    framed = ["\x02héllo\x03", "\x02a\x01b\x03", "\x02\x03", "\x02" + "x" * 9 + "\x03"]
    assert size.tolist() == [sum(max(0, len(f) - n + 1) for n in toxicity.ORDERS) for f in framed]
    assert len(flat) == size.sum() and len(np.unique(flat[-size[3] :])) == len({f for n in toxicity.ORDERS for f in (framed[3][k : k + n] for k in range(12 - n))})


# ---------------------------------------------------------------- the pipeline
def test_pipeline_by_brute_force(spark):
    """Stages 2 to 4 follow from texts alone; stage 1 from its scores; stage 5 packs all that is left."""
    sf = "/root/testdata/sf0.001"
    docs = common.table(spark, sf, "documents")
    kept = corpus_pipeline.filter_quality(spark, docs, sf)
    texts = {r["doc_id"]: r["text"] or "" for r in kept.collect()}
    first = {}
    for i in sorted(texts):
        first.setdefault(__import__("re").sub(r"[\x20\x09-\x0D]+", " ", texts[i]), i)
    texts = {i: texts[i] for i in first.values()}
    texts = {i: texts[i] for i, (_, c) in brute_components(texts, 5).items() if i == c}
    whole = lambda t: f" {b' '.join(decontaminate.words(t)).decode()} "
    items = [whole(r["text"]) for r in common.table(spark, sf, "benchmark").collect()]
    texts = {i: t for i, t in texts.items() if not any(x in whole(t) for x in items)}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf).select("doc_id").distinct().collect()} == set(texts)


# ---------------------------------------------------------------- word tables
@pytest.mark.parametrize("limit", [1000, 20])
def test_word_tables_give_what_was_computed(limit):
    """Ragged rows of words that come up once, often, or after the table began anew, against computing each time."""
    rng = random.Random(limit)
    own = lambda w: [int(w), *range(int(w) % 4)] if int(w) % 5 else []
    table = common.WordTable(lambda words: [own(w) for w in words], limit)
    for _ in range(300):
        words = [str(min(rng.randrange(60), rng.randrange(400))) for _ in range(rng.randrange(30))]
        rows = table.rows(words)
        assert table.gather(rows).tolist() == [x for w in words for x in own(w)] and len(table.index) <= limit + 30
        assert table.size[rows].tolist() == [len(own(w)) for w in words]
