"""Decontamination, prefix trie and vector codes against brute force and DuckDB, with nulls, empty and very
long rows, ties, repeated rows, empty tables and clashing column names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from evloom.llm import decontamination as dc
from evloom.llm import prefix_trie as pt
from evloom.llm import vector_codes as vc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def key(r):
    return tuple((x is not None, x) for x in r)


def sha(parts):
    return hashlib.sha256(",".join(map(str, parts)).encode()).hexdigest()


# Decontamination


def folded(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def plain_hits(docs, items, n):
    windows = defaultdict(set)
    for i, t in items:
        w = folded(t)
        k = min(n, len(w))
        for a in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[a : a + k])].add(i)
    out = []
    for d, t in docs:
        w, hit, found = folded(t), set(), set()
        for k in {len(x) for x in windows}:
            for a in range(len(w) - k + 1):
                if tuple(w[a : a + k]) in windows:
                    hit |= set(range(a, a + k))
                    found |= windows[tuple(w[a : a + k])]
        found.discard(None)
        out.append((d, len(w), len(hit), len(found), sha(sorted(map(str, found))), bool(hit)))
    return sorted(out, key=key)


def some_words(rng, n):
    return rng.choice([" ", ", ", "\n", "--"]).join(rng.choice(["A", "b", "É", "x9", "日本", "q" * 70, "w"]) for _ in range(n))


def benchmark_case(seed=1):
    rng = random.Random(seed)
    items = [(i, some_words(rng, rng.randrange(0, 9))) for i in range(40)] + [(None, "zz top"), (7, None), (8, ""), (3, some_words(rng, 6)), (3, some_words(rng, 6)), (9, "?!")]
    docs = [(i, some_words(rng, rng.randrange(0, 60))) for i in range(150)] + [(None, "x9 zz top!"), (1, None), (2, ""), (2, ""), (501, " -- "), (500, some_words(rng, 20_000))]
    return docs, items


@pytest.mark.parametrize(("n", "most"), [(3, 8 << 20), (3, 200), (10, 8 << 20), (2, 300)])
def test_contamination(spark, n, most):
    docs, items = benchmark_case(n)
    d = spark.createDataFrame([(*r, "f", 1) for r in docs], "doc_id long, text string, f string, row int").repartition(3)
    b = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, words int")
    found = dc.contamination(d, b, n=n, most=most)
    got = found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert sorted(map(tuple, got), key=key) == plain_hits(docs, items, n)
    for r in found.join(d, "doc_id").where("doc_id < 100").collect():  # spans name the words by their bytes, too
        w, raw = folded(r.text), (r.text or "").encode()
        for s in r.spans:
            assert folded(raw[s.start : s.end].decode()) == w[s.lo : s.hi]


def test_contamination_of_empty_tables(spark):
    docs, items = benchmark_case()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert dc.contamination(d.limit(0), b).count() == 0
    assert dc.contamination(d, b.limit(0)).agg({"n_hit": "sum"}).first()[0] == 0


@pytest.mark.parametrize("most", [8 << 20, 300])
def test_decontaminated(spark, most):
    docs = [(1, "one two, Three FOUR. five", 25), (2, "clean text", 10), (3, "a b two three four c d e f", 26), (4, None, None), (5, "two three four", 14)]
    d = spark.createDataFrame([(*r, "t") for r in docs], "doc_id long, text string, n_chars long, t string")
    b = spark.createDataFrame([(1, "two three four"), (2, "zz " * 200)], "item_id long, text string")
    got = {r.doc_id: (r.text, r.n_chars) for r in dc.decontaminated(d, b, n=3, most_percent=60, most=most).collect()}
    assert got == {1: ("one . five", 10), 2: ("clean text", 10), 3: ("a b  c d e f", 12), 4: (None, None)}
    assert dc.decontaminated(d, b, n=3, most_percent=0, most=most).columns == d.columns
    assert {r.doc_id for r in dc.decontaminated(d, b, n=3, most_percent=0, most=most).collect()} == {2, 4}


# Prefix trie


def plain_trie(rows, rebuild):
    conv = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            conv[c].append((t is not None, t or 0, r or "", x or ""))
    conv = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in conv.items()}
    h = {c: zlib.crc32(str(c).encode()) % 9 if rebuild else 0 for c in conv}
    made = {c: tuple((conv.get(c - c % 5, [])[: h[c]] if rebuild else []) + v[h[c] :]) for c, v in conv.items()}
    nodes, kids = defaultdict(list), defaultdict(list)
    for c, v in made.items():
        for d in range(len(v) + 1):
            nodes[v[:d]].append(c)
    for k in nodes:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(nodes, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = (len(nodes[k]) - 1) * (len(k[-1][1].encode()) if k else 0) + sum(saved[x] for x in kids[k])
    out = [(min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), len(kids[k]), leaves[k], saved[k], sha(sorted(c for c in m if len(made[c]) == len(k)))) for k, m in nodes.items()]
    return sorted(out, key=key)


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turns_case(seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(300):
        c = rng.randrange(0, 400)
        for t in range(rng.randrange(0, rng.choice([3, 12, 14]))):
            text = rng.choice(["x", "y", "é", None, ""]) if rng.random() < 0.4 else "x"
            rows.append((c, rng.choice([t, t, t, None, 3]), rng.choice(["u", "a", None]) if rng.random() < 0.2 else "u", text))
    return rows + rows[:3] + [(None, 1, "u", "x"), (410, 1, "u", "long " * 100_000), (411, 1, "u", "long " * 100_000)]


@pytest.mark.parametrize(("seed", "waiting", "piece", "split"), [(0, 4096, 1 << 15, "128m"), (1, 2, 2, "2000"), (2, 3, 1 << 15, "3000")])
def test_prefix_trie(spark, monkeypatch, seed, waiting, piece, split):
    """Also with stretches of a few rows, which nodes cross, and with few children waiting for their parent."""
    monkeypatch.setattr(pt, "WAITING", waiting)
    monkeypatch.setattr(pt, "PIECE", piece)
    rows = turns_case(seed)
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, node int").repartition(3)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        for rebuild in (True, False):
            got = sorted(map(tuple, pt.prefix_trie(df, rebuild=rebuild).select(*TRIE).collect()), key=key)
            assert got == plain_trie(rows, rebuild)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_prefix_trie_sql_with_ties_and_nulls():
    rows = turns_case(5)
    con = duckdb.connect()
    con.execute("create table conversations(conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    assert sorted((tuple(r) for r in con.execute(pt.ORACLE).fetchall()), key=key) == plain_trie(rows, True)


def test_prefix_trie_of_no_conversations(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert pt.prefix_trie(none).count() == 0


# Vector codes


def plain_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, lab, v) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    x = [[math.floor(4096 * float(np.float32(c))) for c in v] for _, _, v in kept]
    w, codes, error, books = len(x[0]) // parts, [""] * len(x), [0] * len(x), []
    for p in range(parts):
        own = [v[p * w : (p + 1) * w] for v in x]
        book = [list(q) for q in own[:entries]]
        for r in range(rounds + 1):
            near = [min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), e) for e, c in enumerate(book)) for q in own]
            for e in range(len(book) if r < rounds else 0):
                mine = [q for q, (_, f) in zip(own, near, strict=True) if f == e]
                if mine:
                    book[e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
        for k, (d, e) in enumerate(near):
            codes[k] += f"{e:02x}"
            error[k] += d
        books += [c for b in book for c in b]
    label = Counter()
    for (_, lab, _), e in zip(kept, error, strict=True):
        label[lab] += e
    return sorted(((i, c, e, label[lab], sha(books)) for (i, lab, _), c, e in zip(kept, codes, error, strict=True)), key=key)


def vectors_case(n, width, scale=1.0, seed=0):
    rng = random.Random(seed)
    rows = [(i, [round(rng.choice([rng.gauss(0, 1), 0.5, -0.25]) * scale, rng.choice([1, 5])) for _ in range(8 * width)], rng.choice([1, 2, None])) for i in range(n)]
    odd = [(None, rows[0][1], 3), (rows[1][0], rows[2][1], 1), rows[3], (n, None, 1), (n, [None] * 8 * width, 1), (n, [float("nan")] * 8 * width, 2), (n, [float("inf")] + [0.0] * (8 * width - 1), 1)]
    return rows + odd


@pytest.mark.parametrize(("n", "width", "scale", "block"), [(5, 1, 1.0, 4096), (300, 2, 1.0, 4096), (300, 3, 500.0, 7), (100, 1, 0.001, 16)])
def test_vector_codes(spark, monkeypatch, n, width, scale, block):
    """Also with fewer vectors than entries, components of four bytes, many ties, blocks of a few rows."""
    monkeypatch.setattr(vc, "BLOCK", block)
    rows = vectors_case(n, width, scale, n)
    df = spark.createDataFrame([(*r, "v", 1) for r in rows], "vec_id long, embedding array<float>, label int, v string, code int").repartition(3)
    assert sorted(map(tuple, vc.vector_codes(df).collect()), key=key) == plain_codes(rows)


def test_exponion_search_skips_no_entry():
    rng = np.random.default_rng(3)
    for scale in (2, 50, 4096):
        book = vc.Codebooks(rng.integers(-scale, scale, (3, 16, 4)))
        x = rng.integers(-scale, scale, (500, 3, 4))
        codes, least = book.assign(x, rng.integers(0, 16, (500, 3)).astype(np.uint8))
        d = ((x[:, :, None, :] - book.entries[None]) ** 2).sum(3)
        assert (least == d.min(2)).all()
        assert (codes == d.argmin(2)).all()


def test_vector_codes_refuse_and_leave_out(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert vc.vector_codes(spark.createDataFrame([], schema)).count() == 0
    assert vc.vector_codes(spark.createDataFrame([(1, None, 1), (2, [float("nan")] * 8, 1)], schema)).count() == 0
    for rows in ([(1, [0.0] * 7, 1)], [(1, [0.0] * 8, 1), (2, [0.0] * 16, 1)], [(1, [1e9] * 8, 1)]):
        with pytest.raises(Exception, match="component"):
            vc.vector_codes(spark.createDataFrame(rows, schema)).count()
