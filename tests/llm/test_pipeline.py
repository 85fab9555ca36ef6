"""The pipeline's stages against brute force on a small table with odd rows."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pipeline = pytest.importorskip("corpus_pipeline")
from rulespan.llm import decontaminate, language_id, queries, secret_scan  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, data, tmp_path_factory):
    """Documents with repeated ids, null ids and texts, copies, leaks, secrets, columns named like results; and an empty table."""
    top = tmp_path_factory.mktemp("sf")
    source = spark.read.parquet(f"{data}/documents.parquet").where("length(text) < 6000")
    items = [r.text for r in spark.read.parquet(f"{data}/benchmark.parquet").orderBy("item_id").collect()]
    rows = [tuple(r) for r in source.orderBy("doc_id").collect()]
    english = [r for r in rows if r[2] == "en" and len(r[1].split()) > 60]
    a, b, c = (r[1] for r in english[:3])
    extra = [(3001, a), (3002, a), (3002, b + " one more ending here"), (3002, "a" + a), (None, a), (None, c + " and so it ends"), (3003, None), (3004, ""), (3005, "12 34 5678"), (3006, a[:300] + " " + items[1] + " " + b[:300]), (None, items[2]), (3007, c[:200] + ' token = "' + "0123456789abcdef" * 2 + 'a7" ' + b[200:400])]
    rows += [(i, t, "en", "extra", len(t) if t is not None else None) for i, t in extra]
    frame = spark.createDataFrame(rows, source.schema).selectExpr("*", "1 as score", "'x' as accepted", "2 as component_id", "3 as item_id")
    frame.repartition(3).write.parquet(str(top / "full/documents.parquet"))
    frame.limit(0).write.parquet(str(top / "none/documents.parquet"))
    for name in ("full", "none"):
        spark.read.parquet(f"{data}/benchmark.parquet").write.parquet(str(top / name / "benchmark.parquet"))
    return top


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_stages_against_brute_force(spark, folder):
    sf = str(folder / "full")
    docs = queries.table(spark, sf, "documents")
    names = docs.columns
    stages = dict(pipeline.STAGES)
    held = {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name == "packing":
            held[name] = (docs.collect(), out.collect())
            break
        assert out.columns == names, name
        out.write.parquet(str(folder / f"out/{name}"))
        after = spark.read.parquet(str(folder / f"out/{name}"))
        held[name] = (docs.collect(), after.collect())
        docs = after
    assert list(stages) == ["language_id", "jaccard_join", "decontamination", "secret_scan", "packing"]

    # Languages: each row by its own text, by the classifier itself.
    before, after = held["language_id"]
    model = language_id.Classifier(*language_id.fit(queries.table(spark, sf, "documents")))
    assert Counter(map(str, after)) == Counter(str(r) for r in before if model.guess(r.text)[2])
    assert len(after) > 0.9 * len(before) and not any(r.text in (None, "", "12 34 5678") for r in after)

    # Near-duplicates: one row of each component, the one of least id.
    before, after = held["jaccard_join"]
    sets = [shingles(r.text) for r in before]
    root = list(range(len(before)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(before)):
        for j in range(i):
            if sets[i] and sets[j] and 4 * len(sets[i] & sets[j]) >= 3 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, r in enumerate(before):
        groups[find(i)].append(r)
    kept = Counter((r.doc_id, r.text) for r in after)
    assert sum(kept.values()) == len(groups) < len(before)
    for rows in groups.values():
        least = min((r.doc_id is None, r.doc_id or 0) for r in rows)
        assert sum(kept[r.doc_id, r.text] > 0 and (r.doc_id is None, r.doc_id or 0) == least for r in {(r.doc_id, r.text): r for r in rows}.values()) == 1
    assert any(t and t.endswith("one more ending here") or t and t.endswith("and so it ends") for _, t in kept) or len(groups) > 100

    # Leaks: no window of a kept row is like an item; what went has one.
    before, after = held["decontamination"]
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    grams = lambda w: Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    items = [words(r.text) for r in queries.table(spark, sf, "benchmark").collect()]
    by_gram = defaultdict(set)
    for n, w in enumerate(items):
        for g in grams(w):
            by_gram[g].add(n)

    def leak(text):
        w = words(text or "")
        for n in {n for g in grams(w) for n in by_gram.get(g, ())}:
            x, m = grams(items[n]), len(items[n])
            for s in range(max(1, len(w) - m + 1)):
                y = grams(w[s : s + m])
                if 4 * (x & y).total() >= 3 * (x | y).total():
                    return True
        return False

    stayed = Counter((r.doc_id, r.text) for r in after)
    went = Counter((r.doc_id, r.text) for r in before) - stayed
    assert sum(went.values()) >= 2 and all(leak(t) for _, t in went) and (None in {i for i, _ in went})
    assert sum(leak(t) for _, t in stayed) <= 0.03 * sum(went.values())

    # Secrets: the same rows, marks in place of keys.
    before, after = held["secret_scan"]
    assert len(before) == len(after) and Counter(r.doc_id for r in before) == Counter(r.doc_id for r in after)
    texts = {r.text for r in after}
    assert any(secret_scan.REDACTED in (t or "") for t in texts) and not any(re.search(r'token = "[0-9a-f]{32}', t or "") for t in texts)
    for r in after:
        assert r.n_chars == (len(r.text) if r.text is not None else None) or secret_scan.REDACTED not in (r.text or "")

    # Packing: all tokens of all rows, once each, and whole sequences.
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    before, after = held["packing"]
    want = Counter()
    for r in before:
        want[r.doc_id] += len(library.encode(r.text or "", add_special_tokens=False).ids) + 1
    got = Counter()
    for r in after:
        got[r.doc_id] += r.length
    assert got == want
    full = defaultdict(int)
    for r in after:
        full[r.sequence_id] += r.length
        assert r.length > 0 and 0 <= r.ids_crc32 < 2**32
    assert all(n & (n - 1) == 0 and n <= 4096 for n in full.values())


def test_run_and_empty_tables(spark, folder):
    assert pipeline.run(spark, str(folder / "none")).count() == 0
    out = pipeline.run(spark, str(folder / "full"))
    assert out.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 100


def test_packing_tiers_and_step_groups(spark, data):
    """Sequences of one tier, step groups of equal tokens, documents in the least tier that holds their tail; very long texts."""
    from rulespan.llm import packing

    long = " ".join(f"w{k % 977}" for k in range(60_000))
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(7000, long)], "doc_id long, text string")).coalesce(1)
    rows = packing.pack(docs, queries.vocabulary("word_bpe_49k.json"), 2, tiers=(256, 512, 1024), group_tokens=4096).collect()
    windows, groups = {}, defaultdict(lambda: defaultdict(int))
    for r in rows:
        assert windows.setdefault(r.sequence_id, r.window) == r.window and r.length <= r.window
        groups[r.step_group][r.sequence_id] = r.window
    by_window = defaultdict(list)
    for g in groups.values():
        assert len(set(g.values())) == 1
        by_window[next(iter(g.values()))].append(sum(g.values()))
    for window in (256, 512, 1024):
        full = sorted(by_window[window])
        assert full[1:] == [4096] * (len(full) - 1)  # all but the last
    assert len(by_window[1024]) > 10 and len(by_window) > 1
    pieces = sorted((r.start, r.length) for r in rows if r.doc_id == 7000)
    assert pieces[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:], strict=False)) and len(pieces) > 58
    assert zlib.crc32(b"") == 0 and np.sum([n for _, n in pieces]) == rows[[r.doc_id for r in rows].index(7000)].doc_tokens


def test_drop_leaks_keeps_columns(spark, folder):
    docs = queries.table(spark, str(folder / "full"), "documents")
    kept = decontaminate.drop_leaks(spark, docs, queries.table(spark, str(folder / "full"), "benchmark"))
    assert kept.columns == docs.columns and kept.where("text is null").count() == docs.where("text is null").count()
