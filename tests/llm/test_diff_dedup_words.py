"""Snapshot difference, exact dedup and spelling variants against plain versions, on small tables with odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import op11_snapshot_diff as o11
from sparkloom.llm import op12_exact_dedup as o12
from sparkloom.llm import op13_spelling_variants as o13
from sparkloom.llm import scratch

DOCS = "doc_id long, text string, lang string, source string, n long, rank long, k string, v string, h long, part int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "clash", "clash", 3, 4) for r in rows], DOCS).repartition(5)


def plain_diff(old, new):
    """Counter of (key, old_key, op, changed, sha) for rows (k, text, lang, source); repeated keys pair in order of value."""
    out, names = Counter(), ("text", "lang", "source")

    def digest(r):
        return hashlib.sha256("\n".join("~" if x is None else x for x in r[1:]).encode()).hexdigest()

    def order(r):
        return [(x is not None, hashlib.sha256(x.encode()).digest() if k == 0 and x is not None else (x or "").encode()) for k, x in enumerate(r[1:])]

    def keyed(rows):
        got = defaultdict(list)
        for r in rows:
            if r[0] is not None:
                got[r[0]].append(r)
        return {(k, i): r for k, v in got.items() for i, r in enumerate(sorted(v, key=order))}

    def pair(a, b, op):
        changed = ",".join(n for n, x, y in zip(names, a[1:], b[1:]) if x != y)
        out[b[0], a[0], op or ("update" if changed else "same"), changed, digest(b)] += 1

    a, b = keyed(old), keyed(new)
    for k in a.keys() & b.keys():
        pair(a[k], b[k], None)
    left, right = defaultdict(list), defaultdict(list)
    for rows, mine, other, to in ((old, a, b, left), (new, b, a, right)):
        for r in [r for k, r in mine.items() if k not in other] + [r for r in rows if r[0] is None]:
            to[r[1], r[2]].append(r)
    key = lambda r: (r[0] is not None, r[0] or 0, r[3] is not None, r[3] or "")
    for c in left.keys() | right.keys():
        x, y = sorted(left[c], key=key), sorted(right[c], key=key, reverse=True)
        for p, q in zip(x, y):
            pair(p, q, "rekey")
        for p in x[len(y) :]:
            out[p[0], p[0], "delete", "", None] += 1
        for q in y[len(x) :]:
            out[q[0], None, "insert", "", digest(q)] += 1
    return out


def diff(spark, old, new, top):
    got = o11.snapshot_diff(frame(spark, old), frame(spark, new), "doc_id", ["text", "lang", "source"], ["text", "lang"], top=top)
    return Counter(tuple(r) for r in got.select("key", "old_key", "op", "changed", "row_sha256").collect())


@pytest.mark.parametrize("top", [2, 4096])
def test_snapshot_diff(spark, top):
    random.seed(top)
    old = [(k, random.choice([None, "", "a", "b", f"t{k}", f"t{k}"]), random.choice([None, "en", "de"]), random.choice([None, "x", "y"])) for k in range(-400, 400)]
    old += [(None, "gone", "en", "x"), (None, "a", "en", "y"), (5, "again", None, None), (5, "again", None, None), (6, "é" * 5000, "fr", None)]
    new = []
    for k, *v in old:
        what = random.randrange(12)
        if what == 0 and k is not None:
            continue
        if what == 1:
            v = [v[0], v[2], v[1]]
        new.append((k if what not in (2, 3) or k is None else 10_000 - k, *v) if what != 4 else (k, f"{v[0]}+", *v[1:]))
    new += [(20_000 + i, "a", "en", None) for i in range(30)]
    new = [r for r in new if r != (None, "gone", "en", "x")]
    assert diff(spark, old, new, top) == plain_diff(old, new)
    assert {op for _, _, op, _, _ in plain_diff(old, new)} == {"same", "update", "rekey", "insert", "delete"}


def test_snapshot_diff_of_equal_and_empty(spark):
    rows = [(k, f"t{k}", None, "x") for k in range(300)]
    assert {k[2] for k in diff(spark, rows, rows, 4)} == {"same"}
    assert Counter(k[2] for k in diff(spark, rows, [], 4)) == {"delete": 300}
    assert Counter(k[2] for k in diff(spark, [], rows, 4)) == {"insert": 300}
    assert not diff(spark, [], [], 4)
    few = [r if r[0] != 17 else (17, "other", None, "x") for r in rows]
    assert Counter(k[2] for k in diff(spark, rows, few, 4)) == {"same": 299, "update": 1}


def test_trees_skip_equal_stretches(spark):
    """One changed row leaves all but its own leaf equal, and a collision of hashes loses nothing."""
    rows = [(k, f"t{k}", "en", "x") for k in range(3000)]
    short = [scratch.table(o11._short(frame(spark, r), "doc_id", ["text", "lang", "source"], ["text"]), "t") for r in (rows, [(k, t + "!" * (k == 1500), a, b) for k, t, a, b in rows])]
    shape = o11.shape(*short, 4)
    assert len(shape.bits) == 3 and shape.bits[0] == o11.BITS
    a, b = (o11.tree(s, shape) for s in short)
    equal = o11._equal_leaves(a, b)
    assert a.leaves.count() - equal.count() == 1
    for t in (a, b):  # every node of both trees with one hash
        t.nodes = [n.withColumn("hash", F.lit(0).cast("long")) for n in t.nodes]
    assert a.leaves.count() - o11._equal_leaves(a, b).count() == 1


def plain_groups(rows):
    got = defaultdict(list)
    for r in rows:
        got[re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")].append(r[0])
    return got


ODD = [(1, "a  b"), (2, "a\tb"), (3, "a b "), (None, "a b"), (4, None), (5, ""), (6, " "), (7, "\n"), (7, "\n"), (8, "x" * 300_000), (9, "x" * 300_000 + " "), (None, "q"), (None, "q"), (10, "a b"), (11, "ẞ" * 9), (11, "ẞ" * 9)]


@pytest.mark.parametrize("hashed", [F.xxhash64, lambda c: F.xxhash64(F.substring(c, 1, 2)), lambda c: F.lit(-7).cast("long")], ids=["hash", "chains", "one hash"])
def test_exact_dedup(spark, hashed):
    random.seed(1)
    rows = [*ODD, *((100 + i, f"t{random.randrange(3000)}" + " " * random.randrange(1, 3) + "x") for i in range(6000))]
    df = spark.createDataFrame([(i, t, "clash", 1, 2) for i, t in rows], "doc_id long, text string, h string, entry long, part int").repartition(6)
    folder = scratch.new_path(spark, "dedup")
    got = o12.exact_dedup(df, folder, hashed=hashed, bits=2).collect()
    want = plain_groups(rows)
    assert len(got) == len(rows)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in want.items()}
    seen = Counter()
    for r in got:
        ids = by_sha[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == min((i for i in ids if i is not None), default=None)
        assert not r.kept or r.doc_id == r.keep_id
        seen[r.text_sha256] += r.kept
    assert set(seen.values()) == {1}
    later = [(1, "a b"), (None, "brand new"), (90_001, "a  b "), (90_002, "brand  new"), (90_003, "other")]
    more = spark.createDataFrame(later, "doc_id long, text string")
    for version in (0, 1):
        for r in o12.extend(more, folder, version, hashed=hashed).collect():
            t = re.sub(" +", " ", {i: t for i, t in later}[r.doc_id])
            known = len(want[t]) if t in want else 0
            mine = sum(re.sub(" +", " ", x) == t for _, x in later)
            assert r.group_size == known + mine * (version + 1)
            assert r.keep_id == min(i for i in (want[t] if known else [i for i, x in later if re.sub(" +", " ", x) == t]) if i is not None)
            assert r.kept == (not known and version == 0 and r.doc_id == r.keep_id)


def test_buckets_split_and_directory_doubles(tmp_path):
    index = o12.Index(f"file://{tmp_path}", 3)
    keys = random.Random(2).sample(range(1 << 61), 5000) + [0, 0, 1]
    for k in keys:
        index.add([k, 0, 0, 0, 0, 0, 1, True])
    assert index.depth >= 4 and len(index.slots) == 1 << index.depth
    assert all(len(b.chains) <= o12.CAPACITY for b in index.slots)
    assert {k: len(index.chain(k)) for k in keys} == Counter(keys)


def test_exact_dedup_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    folder = scratch.new_path(spark, "dedup")
    assert o12.exact_dedup(empty, folder).count() == 0
    assert o12.extend(spark.createDataFrame([(1, "a")], "doc_id long, text string"), folder, 0).head().kept


def near(x, y):
    if len(x) > len(y):
        x, y = y, x
    if len(x) == len(y):
        return sum(p != q for p, q in zip(x, y)) == 1
    return len(y) - len(x) == 1 and any(y[:k] + y[k + 1 :] == x for k in range(len(y)))


def test_near_pairs(spark):
    random.seed(3)
    for letters in ("abÿ", "abcdeé", "ß"):
        words = sorted({"".join(random.choice(letters) for _ in range(random.randrange(5, 10))) for _ in range(500)})
        got = Counter(tuple(sorted(r)) for r in o13.near_pairs(spark.createDataFrame([(w,) for w in words], "word string")).collect())
        assert got == Counter((x, y) for x in words for y in words if x < y and near(x, y))


def test_spelling_variants(spark):
    random.seed(4)
    stems = ["Straßen", "lörning", "reading", "ALPHABET", "zzzzzz", "Ærøskøbing", "ÀPROPOS"]
    rows = [(i, " ".join(random.choice(stems) for _ in range(random.randrange(90)))) for i in range(60)]
    rows += [(None, "reading 12reading-reading"), (None, None), (7, ""), (7, ""), (900, "q" * 40_000 + " x"), (901, "alphabat alphabat alphabat alphabta alphabta alphabta")]

    def words(i, text):
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            yield run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]

    n = {w: c for w, c in Counter(w for r in rows for w in words(*r)).items() if c >= 3 and len(w) >= 5}
    want = {}
    for w in n:
        close = sorted((x for x in n if near(x, w)), key=lambda x: (-n[x], x))
        want[w] = (n[w], len(close), close[0] if close and n[close[0]] >= 2 * n[w] else None)
    got = {r.word: r for r in o13.spelling_variants(spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, word string, n int").repartition(4)).collect()}
    assert {w: (r.n, r.n_near, r.form) for w, r in got.items()} == want and any(r.form for r in got.values())
    for w, r in got.items():
        while want[w][2]:
            w = want[w][2]
        assert r.root == w and r.form_n == (n[r.form] if r.form else None)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert o13.spelling_variants(empty).count() == 0


def test_roots_of_long_paths(spark):
    chain = [(f"w{k:03d}", f"w{k + 1:03d}") for k in range(37)]
    assert {r.root for r in o13._roots(spark.createDataFrame(chain, "word string, form string")).collect()} == {"w037"}
