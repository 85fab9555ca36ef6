"""The ten operators against brute force on a small table, with nulls, repeats, ties and clashing columns."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

queries = pytest.importorskip("rulespan.llm.queries")
from rulespan.llm import _spread, decontaminate, jaccard_join, language_id, packing, secret_scan, sharding, substring_dedup, token_counts, topk, warc  # noqa: E402
from rulespan.operators.components import least_nodes  # noqa: E402
from rulespan.session import Scratch  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["", None, "one", "a b c", " \n\t ", "a a a a a a a a a a a a a a a a a a a a a a a a a a", "x\x1cy z   w\n\n \n end ", "don't <|endoftext|> stop's", "Élan ÉTÉ 中文 ́x \x00nul", "p" * 3000, " lead", "trail \n"]


@pytest.fixture(scope="module")
def docs(spark, data):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    base = rows[0][1] + " " + rows[3][1]
    near = base.split(" ")
    near[len(near) // 2] = "changed"
    rows += [(1000 + i, t, "en") for i, t in enumerate(ODD)]
    rows += [(2000, base, "en"), (2001, base, "en"), (2002, " ".join(near), "de"), (2003, base.upper(), None), (2004, " ".join(rows[5][1].split()[:60] * 2), "fr"), (2004, " ".join(rows[5][1].split()[:60] * 2), "fr"), (None, base, "en")]
    # Columns whose names clash with those that the operators make.
    frame = spark.createDataFrame([(*r, 1, "k", 2, 3) for r in rows], "doc_id long, text string, lang string, start int, key string, score int, token int").repartition(3).cache()
    frame.count()
    return frame


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def test_packing(spark, docs, rows):
    from tokenizers import Tokenizer

    path = queries.vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = packing.pack(docs, path, 2, tiers=(64, 128, 256)).collect()
    ids = defaultdict(Counter)
    for i, t in rows:
        ids[i][tuple(library.encode(t or "", add_special_tokens=False).ids) + (2,)] += 1
    places = defaultdict(list)
    pieces = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length, r.window))
        pieces[r.doc_id].append(r)
    for i, texts in ids.items():
        assert sum(r.length for r in pieces[i]) == sum(len(t) * n for t, n in texts.items())
        for r in pieces[i]:
            assert any(zlib.crc32(np.array(t[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 and len(t) == r.doc_tokens for t in texts)
    for p in places.values():
        at = 0
        for offset, length, _ in sorted(p):
            assert offset == at and length > 0
            at += length
        assert at == p[0][2] and at & (at - 1) == 0  # no padding at all
    assert packing.pack(docs.limit(0), path, 2).count() == 0


def test_token_counts(docs, rows):
    from tokenizers import Tokenizer

    path = queries.vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    want = Counter((i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 100) for i, t in rows)
    assert Counter(map(tuple, token_counts.count_tokens(docs, path, 100).collect())) == want
    from rulespan.llm._vocab import spaced_counts

    counts, long = spaced_counts(path), " ".join(t or "" for _, t in rows)
    assert sum(1 for _ in counts.parts(long, 500)) > 10 and "".join(counts.parts(long, 500)) == long
    assert counts.count(long) == len(library.encode(long, add_special_tokens=False).ids)


def test_top_k(spark, data):
    table = spark.read.parquet(f"{data}/embeddings.parquet")
    odd = spark.createDataFrame([(9000, None), (9001, [1.0, None]), (9002, [float("nan")]), (9003, []), (9004, [0.5]), (9004, [0.5]), (100, [3.0] * 70), (None, [1.0])], "vec_id long, embedding array<float>")
    table = table.select("vec_id", "embedding").unionByName(odd).unionByName(table.select("vec_id", "embedding").limit(20))
    rows = [(r.vec_id, np.floor(256 * np.array(r.embedding, float)).astype(int)) for r in table.collect() if r.vec_id is not None and r.embedding is not None and all(x is not None and np.isfinite(x) for x in r.embedding)]
    x = np.zeros((len(rows), 70), int)
    for i, (_, v) in enumerate(rows):
        x[i, : len(v)] = v
    got = defaultdict(list)
    asked = table.where("vec_id % 50 = 0 and vec_id <> 100")
    for r in topk.top_k(table, asked, 5, block=97).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    wanted = {r.vec_id for r in asked.collect()} & {i for i, _ in rows}
    assert set(got) == wanted
    for q in wanted:
        v = x[next(k for k, (i, _) in enumerate(rows) if i == q)]
        best = sorted((-int(s), i) for s, (i, _) in zip(x @ v, rows) if i != q)[:5]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]


@pytest.mark.parametrize("levels, rounds", [(topk.LEVELS, topk.ROUNDS), ((), (1.0,)), ((0.3,), (0.1, 0.2, 0.4, 0.6, 0.8, 1.0))])
def test_index_stops_only_on_proof(levels, rounds):
    rng = np.random.default_rng(1)
    x = (rng.standard_normal((900, 24)) * 40).astype(np.int64)
    x[5:40] = x[5]
    x[60:70] *= 2**18
    index = topk.ImpactIndex(x, levels)
    q = np.stack([x[5], x[100], np.zeros(24, np.int64), -x[7], x[61], *x[200:230]])
    own = np.zeros((len(q), len(x)), bool)
    own[1, 100] = own[4, 61] = True
    for start in (None, 0, 500):
        floor = np.full(len(q), topk.NONE)
        want = []
        for i, v in enumerate(q):
            scores = np.where(own[i], topk.NONE, x @ v)
            cut = np.sort(scores)[-4]
            want += [(i, int(r), int(scores[r])) for r in np.flatnonzero(scores >= cut)]
            if start is not None:
                floor[i] = cut - start
        got = list(zip(*(c.tolist() for c in index.search(q, 4, floor, own, rounds)), strict=True))
        assert set(got) >= set(want) and len(set(got)) == len(got)
        assert len(got) < len(q) * len(x) / (4 if levels == topk.LEVELS else 2)
        best = topk._best(*(np.array(c) for c in zip(*got, strict=True)), 4)
        assert sorted(zip(*(c.tolist() for c in best), strict=True)) == sorted(r for i in range(len(q)) for r in sorted((w for w in want if w[0] == i), key=lambda w: (-w[2], w[1]))[:4])


def test_top_k_in_many_cells(spark, data, monkeypatch):
    """Several blocks on both sides, some in one task, and empty sides."""
    table = spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "embedding")
    asked = table.where("vec_id % 7 = 0")
    want = sorted(map(tuple, topk.top_k(table, asked, 3).collect()))
    for name, n in (("QUERIES", 9), ("TASK_ROWS", 4), ("TASK_QUERIES", 3), ("TASKS", 3)):
        monkeypatch.setattr(topk, name, n)
    assert sorted(map(tuple, topk.top_k(table, asked, 3, block=31).collect())) == want and len(want) == 3 * asked.count()
    assert topk.top_k(table, asked.limit(0), 3).count() == 0 and topk.top_k(table.limit(0), asked, 3).count() == 0
    assert sorted((r.rank, r.vec_id) for r in topk.top_k(table.where("vec_id in (0, 1, 2)"), table.where("vec_id = 0"), 5).collect())[0][0] == 1
    clash = table.withColumnsRenamed({"vec_id": "score", "embedding": "rank"}).selectExpr("score", "rank", "1 as query_id", "2 as cell", "3 as vec_id")
    assert sorted(map(tuple, topk.top_k(clash, clash.where("score % 7 = 0"), 3, "score", "rank").collect())) == want


def brute_repeats(rows, n):
    places = defaultdict(set)
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in words:
        if i is not None:
            for s in range(len(w) - n + 1):
                places[tuple(w[s : s + n])].add((i, s))
    out = Counter()
    for i, w in words:
        gone = set()
        local = set()
        for s in range(len(w) - n + 1):
            g = tuple(w[s : s + n])
            if g in local or (i is not None and min(places[g])[0] < i):
                gone.update(range(s, s + n))
            local.add(g)
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


def test_substring_dedup(docs, rows):
    got = substring_dedup.remove_repeats(docs, 20)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == brute_repeats(rows, 20)
    for r in got.collect():
        assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 and sum(x.length for x in r.removed) == r.n_removed
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0


def brute_components(rows, words=5):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(lower))
        sets.append({tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set())
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = defaultdict(list)
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[find(a)].append(i)
    return Counter((i, len(s), min(least[find(a)], default=None)) for a, ((i, _), s) in enumerate(zip(rows, sets)))


def test_jaccard_join(spark, docs, rows, monkeypatch):
    want = brute_components(rows)
    assert Counter(map(tuple, jaccard_join.link_components(spark, docs).collect())) == want
    assert jaccard_join.link_components(spark, docs.limit(0)).count() == 0


def test_jaccard_join_in_small_tiles(spark, monkeypatch):
    """A passage that all share, chains of near copies, and tiles of three rows."""
    rng = np.random.default_rng(3)
    passage = [f"p{k}" for k in range(30)]
    rows = []
    for c in range(12):
        own = [f"c{c}w{rng.integers(1000)}" for _ in range(8 + 3 * c)]
        for k in range(5):
            w = list(own)
            for j in range(k):
                w[(3 * j) % len(w)] = f"z{rng.integers(1000)}"
            rows.append((len(rows), " ".join(passage + w)))
    monkeypatch.setattr(jaccard_join, "TILE", 3)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute_components(rows)
    assert Counter(map(tuple, jaccard_join.link_components(spark, frame).collect())) == want
    # Different sets that share their first signature are told apart by the second.
    assert Counter(map(tuple, jaccard_join.link_components(spark, frame, signature_bits=4).collect())) == want


def test_jaccard_join_writes_few_tables(spark, monkeypatch):
    """Rounds of joins only where links are many; pairs are given again only where some were held back."""
    rng = np.random.default_rng(4)
    base = [f"b{k}" for k in range(40)]
    rows = []
    for c in range(40):
        w = list(base)
        for j in rng.choice(40, 1 + c % 3, replace=False):
            w[j] = f"z{c}x{j}"
        rows.append((c, " ".join(w)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want, written, put = brute_components(rows), [], Scratch.put
    monkeypatch.setattr(Scratch, "put", lambda self, df, name: written.append(name) or put(self, df, name))

    def run():
        written.clear()
        assert Counter(map(tuple, jaccard_join.link_components(spark, frame).collect())) == want
        return list(written)

    monkeypatch.setattr(jaccard_join, "FEW", 1_000_000)
    assert "few" in (once := run()) and "all" not in once and len(once) <= 16
    monkeypatch.setattr(jaccard_join, "FEW", 1)
    assert "all" in (twice := run()) and len(twice) <= 22
    monkeypatch.setattr(jaccard_join, "FEW_LINKS", 0)
    assert "round1" in run()


def test_least_nodes_of_edges():
    rng = np.random.default_rng(6)
    for n in (0, 1, 5, 60, 400):
        a, b = rng.integers(-n, n + 1, n), rng.integers(-n, n + 1, n)
        root = {x: x for x in [*a.tolist(), *b.tolist()]}
        for _ in range(n):
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                root[x] = root[y] = min(root[x], root[y])
        assert dict(zip(*(x.tolist() for x in least_nodes(a, b)), strict=True)) == root


def test_bitmap_bounds_from_above():
    rng = np.random.default_rng(5)
    for _ in range(200):
        pool = rng.integers(0, 2**63, 300).astype(np.uint64)
        a, b = (np.unique(rng.choice(pool, int(rng.integers(1, 250)))) for _ in range(2))
        assert jaccard_join.bound(len(a), jaccard_join.bitmap(a), len(b), jaccard_join.bitmap(b)) >= len(np.intersect1d(a, b))
    sim = jaccard_join.Similarity(Fraction(3, 4))
    for n in range(1, 400):
        for m in range(-(-3 * n // 4), n + 1):
            assert sim.band(n) - sim.band(m) in (0, 1)


def test_decontamination(spark, data, docs):
    items = spark.read.parquet(f"{data}/benchmark.parquet")
    texts = [(r.item_id, r.text) for r in items.collect()]
    clean = "alpha beta gamma delta epsilon " * 3
    changed = texts[2][1].split(" ")
    changed[1] = "altered"
    long = " ".join(f"w{k}" for k in range(300))
    rows = [(8, "Too, SHORT!"), (9, "it is too short"), (1, clean + texts[0][1].upper() + " " + clean), (2, clean), (3, clean + " ".join(changed)), (4, None), (5, ""), (6, texts[1][1]), (6, texts[1][1]), (7, "z " * 50 + " ".join(long.split()[:280])), (10, " ".join(long.split()[:150])), (11, clean + " ".join(long.split()[30:]) + clean), (None, texts[3][1])]
    items = items.unionByName(spark.createDataFrame([(900, "too short"), (901, None), (902, long)], "item_id long, text string"))
    got = {(r.doc_id, r.item_id): (r.start, r.n_words, r.similarity) for r in decontaminate.find_leaks(spark, spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert set(got) == {(1, 0), (3, 2), (6, 1), (7, 902), (11, 902), (8, 900), (None, 3)}
    assert got[1, 0] == (15, len(texts[0][1].split()), 1.0) and 0.75 <= got[3, 2][2] < 1
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(spark, docs, items).collect()}
    assert found >= {(r.doc_id, i) for r in docs.collect() if r.text and r.doc_id is not None for i, t in texts if t in r.text}


def grams(w):
    return Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))


def weighted(a, b):
    return (a & b).total() / max(1, (a | b).total())


def test_decontamination_against_every_window(spark, data):
    """All windows of all texts against all items, brute force, with items changed at many places and one of 400 words; and the radius's recall."""
    items = spark.read.parquet(f"{data}/benchmark.parquet")
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").where("length(text) < 2500").orderBy("doc_id").limit(60).collect()]
    clean = lambda t: re.findall(r"[^\W_]+", t.lower())
    texts = {r.item_id: clean(r.text) for r in items.collect()}
    texts[950] = [f"v{k % 230}" if k % 7 else "of" for k in range(400)]
    items = items.unionByName(spark.createDataFrame([(950, " ".join(texts[950]))], "item_id long, text string"))
    rng = np.random.default_rng(4)
    base = [clean(t) for _, t in docs]
    rows = [(d, t) for d, t in docs]
    for n, (_, w) in enumerate(4 * list(texts.items())):
        w = list(w)
        for _ in range(int(rng.integers(0, 1 + len(w) // 18))):
            k = int(rng.integers(len(w)))
            w[k : k + int(rng.integers(0, 3))] = [["new"], []][int(rng.integers(2))]
        host = base[n % len(base)]
        at = int(rng.integers(len(host) + 1))
        rows.append((10_000 + n, " ".join(host[:at] + w + host[at:])))
    want = {}
    for d, t in rows:
        w = clean(t)
        for i, x in texts.items():
            g, m = grams(x), len(x)
            if len(w) >= m and set(g) & set(grams(w)):
                best = max(weighted(grams(w[s : s + m]), g) for s in range(len(w) - m + 1))
                if best >= 0.75:
                    want[d, i] = round(best, 6)
    found = decontaminate.find_leaks(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4), items).collect()
    got = {(r.doc_id, r.item_id): r.similarity for r in found if len(clean(dict(rows)[r.doc_id])) >= len(texts[r.item_id])}
    assert set(got) <= set(want) and all(got[k] <= want[k] for k in got)
    assert len(want) > 60 and len(got) >= 0.97 * len(want), {k: want[k] for k in set(want) - set(got)}
    assert sum(got[k] == want[k] for k in got) >= 0.95 * len(got)
    assert any((10_000 + k * len(texts) - 1, 950) in got for k in range(1, 5))


def test_decontamination_plans_once_what_items_give(spark, data, docs):
    """Shapes, prints and neighbours of items are tables of their own, not parts of the plan over the documents."""
    items = spark.read.parquet(f"{data}/benchmark.parquet")
    plan = decontaminate.find_leaks(spark, docs, items)._jdf.queryExecution().executedPlan().toString()
    print(plan.count("Exchange"), plan.count("Aggregate"), len(plan))
    assert plan.count("Exchange") <= 16 and plan.count("Aggregate") <= 12


def test_decontamination_of_odd_rows(spark, data):
    """Ties, empty tables on either side, clashing names; rows that share an id, or have none, are decided one by one."""
    items = spark.createDataFrame([(1, "a b c d e f g h"), (2, "a b c d e f g h"), (None, None), (3, "")], "item_id long, text string").selectExpr("*", "1 as doc_id", "2 as m", "3 as start")
    rows = [(5, "x y z a b c d e f g h a b c d e f g h"), (5, "clean words only here now"), (None, "a b c d e f g h"), (None, "other clean words"), (7, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as key", "3 as similarity", "4 as whole")
    got = {(r.doc_id, r.item_id): (r.start, r.similarity, r.n_windows) for r in decontaminate.find_leaks(spark, docs, items).collect()}
    assert got == {(5, 1): (3, 1.0, 2), (5, 2): (3, 1.0, 2), (None, 1): (0, 1.0, 1), (None, 2): (0, 1.0, 1)}
    kept = decontaminate.drop_leaks(spark, docs, items)
    assert kept.columns == docs.columns and sorted((r.doc_id, r.text) for r in kept.where("text is not null and doc_id is not null").collect()) == [(5, rows[1][1]), (7, "")] and kept.count() == 4
    assert decontaminate.find_leaks(spark, docs.limit(0), items).count() == 0 and decontaminate.drop_leaks(spark, docs, items.limit(0)).count() == len(rows)


def test_decontamination_of_shorter_documents(spark, data):
    """Items with words missing, alone in a document: all whose similarity is 0.75 or more, and no others."""
    items = spark.read.parquet(f"{data}/benchmark.parquet")
    texts = [(r.item_id, re.findall(r"[^\W_]+", r.text.lower())) for r in items.collect()][:40]
    texts += [(901, ["w"] * 8 + [f"w{k}" for k in range(60)]), (902, [f"w{k}" for k in range(60)] + ["w"] * 8)]
    items = items.unionByName(spark.createDataFrame([(i, " ".join(w)) for i, w in texts if i > 900], "item_id long, text string"))
    rng = np.random.default_rng(11)
    cut = []
    for _, w in texts:
        for k in (1, 2, len(w) // 8, len(w) // 5):
            at = int(rng.integers(len(w) - k + 1))
            cut += [w[:-k], w[k:], w[:at] + w[at + k :]]
    cut = [w for w in cut if len(w) >= 1]

    held = {i: (len(w), grams(w)) for i, w in texts}
    want = {}
    for d, w in enumerate(cut):
        g = grams(w)
        for i, (m, x) in held.items():
            if g and x and len(w) < m and 4 * (g & x).total() >= 3 * (g | x).total():
                want[d, i] = (0, len(w), round((g & x).total() / (g | x).total(), 6), 1)
    frame = spark.createDataFrame([(d, " ".join(w)) for d, w in enumerate(cut)], "doc_id long, text string")
    found = decontaminate.find_leaks(spark, frame, items).collect()
    got = {(r.doc_id, r.item_id): (r.start, r.n_words, r.similarity, r.n_windows) for r in found if r.item_id in held and len(cut[r.doc_id]) < held[r.item_id][0]}
    assert len(want) > 100 and got == want
    assert decontaminate.drop_leaks(spark, frame, items).where(f"doc_id in ({','.join(str(d) for d, _ in want)})").count() == 0


def test_fingerprint_is_the_majority(spark):
    from pyspark.sql import functions as F

    values = [[int(x) for x in np.random.default_rng(k).integers(-(2**63), 2**63 - 1, n)] for k, n in enumerate((1, 2, 7, 50, 120))]
    frame = spark.createDataFrame([(v, len(v)) for v in values], "h array<long>, m int")
    fp = decontaminate._fingerprint([decontaminate._counters(F.col("h"), k) for k in range(9)], F.lit(0), F.col("m"))
    for v, got in zip(values, [r[0] for r in frame.select(fp).collect()]):
        assert got == sum(1 << b for b in range(63) if 2 * sum(x >> b & 1 for x in v) > len(v))


def test_warc(spark, tmp_path):
    rows = [(1, "http://a/", "same"), (2, "http://b/", "same"), (3, None, None), (4, "http://d/ x", ""), (5, "http://e/", "<p>\r\n\r\nWARC/1.1\r\nContent-Length: 9\r\n\r\né中</p>\r\n\r\n"), (5, "http://e/", "again"), (6, "u", "again"), (6, "u", "again"), (None, "n", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    captures = warc.round_trip(spark, pages, str(tmp_path / "a"), payloads=True).collect()
    assert len(captures) == len(rows) and all(c.request and c.metadata for c in captures)
    top = defaultdict(lambda: -(2**63))
    for i, _, h in rows:
        top[h or ""] = max(top[h or ""], i if i is not None else -(2**63))
    got = Counter()
    for c in captures:
        i = None if c.capture_key == "null" else int(c.capture_key)
        got[i, c.response.digest, c.response.kind, c.original and int(c.original.capture_key)] += 1
        if c.response.kind == "response":
            assert base64.b32encode(hashlib.sha1(c.response.payload).digest()).decode() == c.response.digest
            assert (i, c.response.payload.decode()) in {(a, h or "") for a, _, h in rows}
    want = Counter()
    for i, _, h in rows:
        last = top[h or ""]
        kind = "response" if (i if i is not None else -(2**63)) == last else "revisit"
        want[i, base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), kind, last if kind == "revisit" else None] += 1
    assert got == want
    warc.write_archives(pages.limit(0), str(tmp_path / "b"))
    assert warc.assemble(warc.read_records(spark, str(tmp_path / "b"))).count() == 0


def test_warc_joins_spread_hot_keys(spark, tmp_path, monkeypatch):
    """Many pages with one payload, pages of several sizes, files of few captures, columns with clashing names."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(_spread, "HEAVY", 2)
    monkeypatch.setattr(warc, "CLASSES", (8, 100))
    monkeypatch.setattr(warc, "FILE_BYTES", 400)
    bodies = lambda k: "hot" if k % 3 == 0 else "warm" if k % 7 == 0 else f"pair {k // 4}" if k % 2 else "l" * (k % 150)
    rows = [(k, bodies(k), "d", "r", 1) for k in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, html string, digest string, `top` string, bytes int").withColumn("url", F.lit("http://x/"))
    got = {int(c.capture_key): (c.response.kind, c.original and int(c.original.capture_key)) for c in warc.round_trip(spark, pages, str(tmp_path / "a")).collect()}
    last = {bodies(k): k for k in range(300)}
    assert got == {k: ("response", None) if last[bodies(k)] == k else ("revisit", last[bodies(k)]) for k in range(300)}
    assert len(list((tmp_path / "a").rglob("*.gz"))) > 20 and len(list((tmp_path / "a").glob("size-*"))) == 3
    # Neither rows without a reference nor those of one original end in one task.
    records = warc.Scratch(spark, "t").put(warc.read_records(spark, str(tmp_path / "a"), False), "r")
    held = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        counts = [r[0] for r in warc.assemble(records).where("response.kind = 'revisit'").groupBy(F.spark_partition_id().alias("p")).count().select("count").collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", held)
    assert len(counts) > 1 and max(counts) < 0.6 * sum(counts)


def test_secrets(spark, docs):
    forest = secret_scan.train_forest(spark)
    held = secret_scan.features(secret_scan.labelled_findings(spark, 6000, start=1_000_000)).withColumn("p", forest)  # none that it was trained on
    shares = {r[0]: r[1] for r in held.groupBy("label").agg(secret_scan.F.avg(((secret_scan.F.col("p") >= 0.5) == (secret_scan.F.col("label") == 1)).cast("double"))).collect()}
    assert min(shares.values()) > 0.97, shares
    key = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    rows = [(1, f'x token = "{key}" y'), (2, f"commit {key} fixed"), (3, "4785380592391139 and 152.143.123.131"), (4, None), (5, ""), (None, f"password: '{key}' z {key}"), (1, "clean")]
    frame = spark.createDataFrame([(*r, "en", 7) for r in rows], "doc_id long, text string, lang string, n_chars long")
    got = {(r.doc_id, r.start): r.is_secret for r in secret_scan.scan(spark, frame, forest).collect()}
    assert got[1, 11] and got[None, 11] and not got[2, 7] and not got[3, 0]
    clean = sorted(secret_scan.redact(spark, frame, forest).collect(), key=str)
    assert len(clean) == len(rows) and list(clean[0].asDict()) == frame.columns
    texts = {r.text for r in clean}
    assert 'x token = "[SECRET]" y' in texts and rows[1][1] in texts and "password: '[SECRET]' z [SECRET]" in texts


def test_planted_secrets_of_many_kinds(spark, data):
    """Recall on keys set into real texts, by place; keys of no kind that the generator makes among them; and what is left alone."""
    forest = secret_scan.train_forest(spark)
    base = [r.text for r in spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/documents.parquet").where("length(text) between 200 and 3000").orderBy("doc_id").limit(150).collect()]
    rng = np.random.default_rng(8)
    random = lambda letters, n: "".join(rng.choice(list(letters), n))
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    shapes = [
        lambda: ('token = "', random("0123456789abcdef", 40), '"'),
        lambda: ("AWS_SECRET_ACCESS_KEY=", random(lower + upper + digits + "+/", 40), " "),
        lambda: ("", "AKIA" + random(upper + "234567", 16), " "),
        lambda: ("api_key: '", random(lower + upper, 23), "'"),  # no digit
        lambda: ('"password": "', random(lower + upper + digits, 12), '"'),  # short
        lambda: ("Authorization: Bearer ", random(lower + upper + digits + "-_", 120), " "),
        lambda: ('private_key = "', base64.b64encode(rng.bytes(1200)).decode(), '"'),
    ]
    rows, want = [], {}
    for d, t in enumerate(base):
        before, key, after = shapes[d % len(shapes)]()
        at = t.find(" ", len(t) // 3) + 1
        rows.append((d, t[:at] + before + key + after + t[at:]))
        want[d] = (at + len(before), key)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = defaultdict(dict)
    for r in secret_scan.scan(spark, frame, forest).collect():
        found[r.doc_id][r.start] = r
    caught = [d for d, (at, key) in want.items() if at in found[d] and found[d][at].is_secret and found[d][at].sha256 == hashlib.sha256(key.encode()).hexdigest()]
    assert len(caught) >= 0.95 * len(want), {d % len(shapes): want[d] for d in set(want) - set(caught)}
    plain = secret_scan.scan(spark, spark.createDataFrame(list(enumerate(base)), "doc_id long, text string").where("text not like '%token%' and text not like '%TOKEN%'"), forest)
    alone = plain.collect()
    wrong = [(r.candidate, r.score) for r in alone if r.is_secret]
    assert len(wrong) <= 0.05 * len(alone), wrong


def test_scan_gives_every_place(spark):
    """Against Python's own matcher: many candidates in one text, repeats, nulls, empty table, clashing columns."""
    pattern = re.compile(secret_scan.KEY + "{16,}={0,2}")
    text = " ".join(f"{hashlib.md5(str(k % 700).encode()).hexdigest()}{'=' * (k % 3)}" for k in range(3000)) + " é中 end"
    rows = [(1, text, "p"), (1, text, "p"), (2, None, "q"), (3, "", "q"), (None, "a-b " + "Qx" * 9, "q")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, candidate string").selectExpr("*", "1 as place", "'x' as found", "2 as score")
    got = Counter((r.doc_id, r.place, r.start, r.candidate) for r in secret_scan.scan(spark, frame, secret_scan.F.lit(0.1)).collect())
    want = Counter((i, k, m.start(), m[0]) for i, t, _ in rows for k, m in enumerate(pattern.finditer(t or "")))
    assert got == want and sum(want.values()) == 6001
    assert secret_scan.scan(spark, frame.limit(0), secret_scan.F.lit(0.1)).count() == 0 and secret_scan.redact(spark, frame.limit(0), secret_scan.F.lit(1.0)).count() == 0


def test_long_secrets_are_taken_whole(spark):
    forest = secret_scan.train_forest(spark)
    keys = [base64.b64encode(b"".join(hashlib.sha512(f"{n} {k}".encode()).digest() for k in range(n))).decode() for n in (3, 20, 400)]
    late = "".join(c for c in keys[2] if c not in "0123456789=")[:250] + keys[1]  # its first digit comes late
    rows = [(k, f'x private_key = "{key}" y', 7) for k, key in enumerate([*keys, late])]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = {r.doc_id: r for r in secret_scan.scan(spark, frame, forest).collect()}
    for k, key in enumerate([*keys, late]):
        assert (got[k].start, got[k].length, got[k].sha256) == (17, len(key), hashlib.sha256(key.encode()).hexdigest())
        assert got[k].is_secret, (k, len(key), got[k].score)
    assert {r.text for r in secret_scan.redact(spark, frame, forest).collect()} == {'x private_key = "[SECRET]" y'}


def test_language_id(spark, data, docs):
    table = spark.read.parquet(f"{data}/documents.parquet")
    dictionaries = language_id.train_dictionaries(table.where("doc_id % 4 <> 2"))
    assert set(dictionaries) == {"en", "de", "fr", "es"} and language_id.train_dictionaries(table.limit(0)) == {}
    found = language_id.identify(table.where("doc_id % 4 = 2"), dictionaries, keep=("lang",)).collect()
    assert sum(r.lang == r.lang_pred for r in found) / len(found) > 0.93
    odd = {r.doc_id: r for r in language_id.identify(docs, dictionaries).collect()}
    assert len(odd) > 200 and odd[1001].lang_pred == "und" and odd[1004].lang_pred == "und" and not odd[1004].accepted
    assert all(0 <= r.score <= 1 for r in odd.values())


def test_language_of_odd_texts(spark, data):
    """Numbers are no letters; short texts have margins too; a language of short texts is learned; kept columns may have any names."""
    table = spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/documents.parquet")
    dictionaries, margins = language_id.fit(table)
    assert [low for low, _ in margins] == [low for low, _ in language_id.MARGINS] and margins[0][0] == 1
    frame = spark.createDataFrame([(1, "\u00bd \u00b2 12", 1), (2, "12 34", 2), (3, None, 3), (4, "der und die", 4)], "doc_id long, text string, score int").selectExpr("*", "'k' as accepted")
    got = {r.doc_id: r for r in language_id.identify(frame, dictionaries, margins, keep=("score", "accepted", "text")).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and not any(got[k].accepted for k in (1, 2, 3)) and got[4].text == "der und die"
    kept = language_id.keep_accepted(table.selectExpr("*", "1 as score", "2 as accepted"), dictionaries, margins)
    assert kept.columns == [*table.columns, "score", "accepted"] and 0.95 * table.count() < kept.count() <= table.where("text is not null").count()
    short = spark.createDataFrame([(k, f"zqxv wvzqk kkqx {k}" if k % 2 else f"aeiou oui ouea {k}", "zz" if k % 2 else "aa") for k in range(40)], "doc_id long, text string, lang string")
    few, _ = language_id.fit(short)
    assert set(few) == {"aa", "zz"} and {r.lang_pred for r in language_id.identify(short.where("lang = 'zz'"), few).collect()} == {"zz"}
    many = spark.createDataFrame([(k, f"word{k} text", f"l{k}") for k in range(50)], "doc_id long, text string, lang string")
    assert len(language_id.fit(many, max_rows=60)[0]) == 50
    assert language_id.identify(frame.limit(0), dictionaries).count() == 0


def test_language_rejects_what_it_does_not_know(spark, data):
    """A language left out of the fit, letters at random, and texts too short to tell."""
    table = spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/documents.parquet").where("length(text) between 300 and 4000")
    dictionaries, margins = language_id.fit(table.where("doc_id % 4 <> 2 and lang <> 'de'"))
    rng = np.random.default_rng(2)
    letters = [(-1 - k, "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), 300 if k % 2 else 1500)), "none") for k in range(100)]
    asked = table.where("doc_id % 4 = 2 or lang = 'de'").select("doc_id", "text", "lang").unionByName(spark.createDataFrame([*letters, (-1000, "Qx.", "short")], "doc_id long, text string, lang string"))
    shares = defaultdict(list)
    for r in language_id.identify(asked, dictionaries, margins, keep=("lang",)).collect():
        shares[r.lang].append(r.accepted)
    share = {k: sum(v) / len(v) for k, v in shares.items()}
    print(margins, share, {k: len(v) for k, v in shares.items()})
    assert share["de"] < 0.2 and share["none"] < 0.05 and share["short"] == 0
    assert all(share[k] > 0.95 for k in ("en", "fr", "es"))


def test_sharding(spark):
    names = [f"s{k}" for k in range(7)]
    table = sharding.fill_table(names, 1009)
    turns = Counter(table)
    assert max(turns.values()) - min(turns.values()) <= 1 and len(table) == 1009
    fewer = sharding.fill_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 6)
    assert moved < 0.2 * 1009  # most slots of the shards that stay are kept
    with pytest.raises(ValueError):
        sharding.fill_table(names, 1000)
    frame = spark.createDataFrame([(k if k % 9 else None, "x", "old") for k in range(500)], "doc_id long, source string, shard string")
    got = sharding.place(spark, frame, names, slots=1009).collect()
    for r in got:
        slot = int(hashlib.md5((f"v{r.doc_id}" if r.doc_id is not None else "n").encode()).hexdigest()[:15], 16) % 1009
        assert (r.slot, r.shard) == (slot, names[table[slot]])
    hot = Counter(r.shard for r in sharding.place(spark, frame, names, key="source", spread=["doc_id"]).collect())
    assert len(hot) == 7
