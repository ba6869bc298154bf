"""Secret scans with corpus-wide ownership frequency, in DataFrame operations only.

Patterns find base spans in every whole text, each kind leftmost and without overlaps; a fourth, broader
pattern finds opaque strings. Every candidate value is hashed, and the hashes are aggregated over the whole
corpus by distinct repositories and distinct owners. A value is a copied example where enough owners and enough
repositories hold it in passages of their own: ``min_owners`` at least, and the base-two logarithm of the corpus' owners, so
that chance meetings of a growing corpus don't reach it while a value that hundreds of thousands wrote always does; any
other one that looks live (letters and digits, enough different characters, no placeholder word) is a
credential of its owners, and its place is added as a span of kind ``live``. Base spans always stay.

A copied passage counts once: of all holders of a value between the same ``AROUND`` characters on both sides
one is taken, by a digest. Where fewer than ``LEAST_AROUND`` characters stand there, as in a text that is one
line, there is nothing that shows a copy, and each holder counts. ``max_owners`` and ``max_repos`` are all holders.

``(hash, passage, repository, owner)`` is made distinct before the counts, on the map side first, so a value
copied into a third of the corpus reaches the counts once for each of its passages, repositories and map tasks. What is
shuffled are candidates, never texts. The frequencies, a row for each distinct value, are written; they join the
matches by broadcast where there are at most BROADCAST_ROWS, else by a shuffle whose long partitions Spark splits.

Positions: the text between the matches (split by the same pattern) and the matches' lengths add up to
each match's start, in code points; a window over a document's matches adds them, since sums within an array take
time with the square of its length.

Cases: null and empty text has no spans; null owner or repository is one owner or repository of its own;
repeated rows and null ``doc_id`` are reported each (rows are told apart by a number of their own); columns
that clash with working names are safe, since inputs are renamed or nested first; texts of any length are read whole; a
value found in one place by several kinds is one live span; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

#: Kind -> (pattern for Java, group that holds the value, least length of the value), in the order of kinds.
KINDS = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),  # runs of 32 or more are just the runs of one or more that are long enough
    "opaque": (r"[A-Za-z0-9+/_=-]{20,}", 0, 20),
}
#: Characters on each side that tell passages apart, and the least of both sides together that do.
AROUND, LEAST_AROUND = 32, 16
#: Owners, and repositories, that must hold a value in passages of their own before it can be an example.
MIN_OWNERS = 5
BASE = ("assign", "access", "hex")
LIVE = "live"
#: Distinct values whose frequencies may be broadcast: at about 120 bytes each, 60 MB.
BROADCAST_ROWS = 500_000
#: Words that mark a value as a placeholder.
PLACEHOLDERS = "example|sample|changeme|placeholder|dummy|your|xxxx|0000000|1234567"


def _matches(text: Column, kind: str) -> Column:
    """Gap before, length, value, digest of the passage (null where too short) of each match; null where there is none."""
    pattern, group, _ = KINDS[kind]
    whole, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    def passage(i: Column) -> Column:
        before, after = F.right(F.get(gaps, i), F.lit(AROUND)), F.left(F.get(gaps, i + 1), F.lit(AROUND))
        return F.when(F.length(before) + F.length(after) >= LEAST_AROUND, F.md5(F.concat_ws("\n", before, after)))

    both = F.transform(whole, lambda m, i: F.struct(F.length(F.get(gaps, i)).alias("gap"), F.length(m).alias("len"), F.get(values, i).alias("value"), passage(i).alias("passage")))
    return F.when(text.rlike(pattern), both)


def looks_live(value: Column) -> Column:
    """Letters and digits, ten different characters or more, no placeholder word."""
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= 10) & ~F.lower(value).rlike(PLACEHOLDERS)


def scan(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repo_cols: tuple[str, ...], carry: bool = False) -> DataFrame:
    """One row per document, written once: _rid, _doc, _owner, _repo, and the matches of each kind; with ``carry`` all columns as ``_c``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    cols = [F.monotonically_increasing_id().alias("_rid"), F.col(id_col).cast("long").alias("_doc"), F.to_json(F.struct(F.col(owner_col).alias("o"))).alias("_owner")]
    cols += [F.to_json(F.struct(*[F.col(c).alias(f"r{k}") for k, c in enumerate(repo_cols)])).alias("_repo"), *[_matches(text, k).alias(f"_m_{k}") for k in KINDS]]
    if carry:
        cols.append(F.struct(*scratch.columns(docs)).alias("_c"))
    return scratch.table(docs.select(*cols), "secret-scan")


def candidates(scanned: DataFrame, min_owners: int) -> DataFrame:
    """One row per match: _rid, kind, start, end, v_start, ok (long enough), n_owners, n_repos, class."""
    def tagged(kind: str) -> Column:
        own = F.coalesce(f"_m_{kind}", F.array().cast(scanned.schema[f"_m_{kind}"].dataType))
        return F.transform(own, lambda m, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), m.alias("m")))

    every = [tagged(k) for k in KINDS]
    rows = scanned.filter(_some()).select("_rid", "_owner", "_repo", F.explode(F.concat(*every)).alias("x")).select("_rid", "_owner", "_repo", "x.kind", "x.i", "x.m.*")
    w = Window.partitionBy("_rid", "kind").orderBy("i")
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(w)).withColumn("start", F.col("end") - F.col("len")).withColumn("v_start", F.col("end") - F.length("value"))
    least = F.element_at(F.create_map(*(F.lit(x) for k, v in KINDS.items() for x in (k, v[2]))), F.col("kind"))
    rows = rows.withColumn("ok", F.length("value") >= least).withColumn("hash", F.sha2("value", 256))
    held = rows.filter("ok").select("hash", F.coalesce("passage", F.concat("_owner", "_repo")).alias("passage"), "_repo", "_owner").distinct()
    freq = held.groupBy("hash").agg(F.countDistinct("_owner").alias("n_owners"), F.countDistinct("_repo").alias("n_repos"))
    one = held.groupBy("hash", "passage").agg(F.min(F.struct(F.md5(F.concat("passage", "_owner", "_repo")), "_owner", "_repo")).alias("o")).select("hash", "o._owner", "o._repo")
    freq = freq.join(one.groupBy("hash").agg(F.countDistinct("_owner").alias("own_owners"), F.countDistinct("_repo").alias("own_repos")), "hash")
    (owners,) = scanned.agg(F.countDistinct("_owner")).head()
    least_held = max(min_owners, (owners - 1).bit_length())
    freq = scratch.table(freq, "secret-owners")
    rows = rows.join(F.broadcast(freq) if freq.count() <= BROADCAST_ROWS else freq, "hash", "left")
    wide = (F.col("own_owners") >= least_held) & (F.col("own_repos") >= least_held)
    kind = F.when(wide, "example").when(F.col("ok") & looks_live(F.col("value")), LIVE).otherwise("other")
    return rows.select("_rid", "kind", "start", "end", "v_start", "ok", "n_owners", "n_repos", kind.alias("class"))


def _some() -> Column:
    out = F.lit(False)
    for k in KINDS:
        out = out | F.col(f"_m_{k}").isNotNull()
    return out


def _spans(found: DataFrame) -> DataFrame:
    """Per document, its base spans and all spans as sorted arrays of (start, order, end, kind), and counts."""
    order = F.array_position(F.array(*map(F.lit, BASE)), F.col("kind")).cast("int")
    base = F.col("ok") & F.col("kind").isin(*BASE)
    own = F.struct(F.col("start").alias("start"), order.alias("o"), F.col("end").alias("end"), F.col("kind").alias("kind"), (F.col("class") == "example").alias("example"))
    live = F.struct(F.col("v_start").alias("start"), F.lit(len(BASE) + 1).alias("o"), F.col("end").alias("end"), F.lit(LIVE).alias("kind"), F.lit(False).alias("example"))
    return found.groupBy("_rid").agg(
        F.sort_array(F.collect_list(F.when(base, own))).alias("base"),
        F.sort_array(F.array_distinct(F.collect_list(F.when(F.col("class") == LIVE, live)))).alias("live"),
        *[F.count(F.when(base & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in BASE],
        F.count(F.when(F.col("ok") & (F.col("class") == "example"), 1)).alias("n_example"),
        F.max("n_owners").alias("max_owners"), F.max("n_repos").alias("max_repos"),
    )


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_scan(
    docs: DataFrame, min_owners: int = MIN_OWNERS, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang")
) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans; and n_live, n_example, max_owners, max_repos."""
    scanned = scan(docs, id_col, text_col, owner_col, repo_cols)
    none = scanned.filter(~_some()).select(F.col("_doc").alias("doc_id"), *[F.lit(0).cast("long").alias(f"n_{k}") for k in BASE], F.sha2(F.lit(""), 256).alias("base_sha256"), F.lit("").alias("spans"), *[F.lit(0).cast("long").alias(c) for c in ("n_live", "n_example", "max_owners", "max_repos")])
    found = _spans(candidates(scanned, min_owners)).join(scanned.filter(_some()).select("_rid", F.col("_doc").alias("doc_id")), "_rid")
    some = found.select(
        "doc_id", *[f"n_{k}" for k in BASE], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.sort_array(F.concat("base", "live"))).alias("spans"),
        F.size("live").cast("long").alias("n_live"), "n_example", F.coalesce("max_owners", F.lit(0)).alias("max_owners"), F.coalesce("max_repos", F.lit(0)).alias("max_repos"),
    )
    return none.unionByName(some)


def redact_secrets(
    docs: DataFrame, mask: str = "[SECRET]", min_owners: int = MIN_OWNERS, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
    repo_cols: tuple[str, ...] = ("source", "lang"), length_col: str | None = "n_chars",
) -> DataFrame:
    """The documents with every live span and every base span that is no copied example (as above) masked, and the
    length column brought up to date. Rows without such spans pass as they are."""
    scanned = scan(docs, id_col, text_col, owner_col, repo_cols, carry=True)
    masks = _spans(candidates(scanned, min_owners)).select("_rid", F.sort_array(F.concat(F.filter("base", lambda s: ~s["example"]), "live")).alias("_mask"))
    passed = scanned.filter(~_some()).select("_c.*")
    hit = scanned.filter(_some()).join(masks, "_rid", "left").select("_c", "_mask")
    text = F.col("_c").getField(text_col)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    step = lambda s, m: F.when(m["end"] <= s["at"], s).otherwise(F.struct(m["end"].cast("long").alias("at"), F.concat(s["out"], text.substr((s["at"] + 1).cast("int"), F.greatest(m["start"] - s["at"], F.lit(0)).cast("int")), F.lit(mask)).alias("out")))
    done = F.aggregate("_mask", start, step, lambda s: F.concat(s["out"], text.substr((s["at"] + 1).cast("int"), F.length(text))))
    hit = hit.select("_c", F.when(F.size("_mask") > 0, done).otherwise(text).alias("_text"))
    own = {text_col: F.col("_text"), length_col: F.length("_text")}
    hit = hit.select(*[own.get(c, F.col("_c").getField(c)).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
    return passed.union(hit)  # both have the columns in their order


#: The scan in DuckDB's SQL, over ``documents`` with ``source`` as owner and ``(source, lang)`` as repository.
SQL = """
WITH t AS (SELECT row_number() OVER () AS r, doc_id, '{"o":"' || source || '"}' AS own, '{"r0":"' || source || '","r1":"' || lang || '"}' AS repo, coalesce(text, '') AS s FROM documents),
m AS (""" + " UNION ALL ".join(
    f"SELECT r, own, repo, '{kind}' AS kind, {o + 1} AS ord, {least} AS least, regexp_extract_all(s, '{p}') AS whole, regexp_extract_all(s, '{p}', {group}) AS value, string_split_regex(s, '{p}') AS gaps FROM t"
    for o, (kind, p, group, least) in enumerate((k, v[0].replace("'", "''"), v[1], v[2]) for k, v in KINDS.items())
) + f"""),
e AS (SELECT r, own, repo, kind, ord, least, unnest(range(1, len(whole) + 1)) AS i, whole, value, gaps FROM m),
p AS (SELECT r, own, repo, kind, ord, value[i] AS value, length(value[i]) >= least AS ok, length(whole[i]) AS n, "right"(gaps[i], {AROUND}) AS before, "left"(gaps[i + 1], {AROUND}) AS after,
    CAST(sum(length(gaps[i]) + length(whole[i])) OVER (PARTITION BY r, kind ORDER BY i) AS BIGINT) AS stop FROM e),
held AS (SELECT DISTINCT value, CASE WHEN length(before) + length(after) >= {LEAST_AROUND} THEN md5(before || chr(10) || after) ELSE own || repo END AS passage, own, repo FROM p WHERE ok),
freq AS (SELECT value, count(DISTINCT own) AS n_owners, count(DISTINCT repo) AS n_repos FROM held GROUP BY value),
one AS (SELECT value, passage, arg_min(own, md5(passage || own || repo)) AS own, arg_min(repo, md5(passage || own || repo)) AS repo FROM held GROUP BY value, passage),
wide AS (SELECT value, count(DISTINCT own) AS o, count(DISTINCT repo) AS q FROM one GROUP BY value),
c AS (SELECT p.*, n_owners, n_repos, stop - n AS start, stop - length(p.value) AS v_start,
    coalesce(least(o, q) >= greatest({MIN_OWNERS}, ceil(log2(greatest(1, (SELECT count(DISTINCT own) FROM t))))), false) AS example,
    ok AND regexp_matches(p.value, '[0-9]') AND regexp_matches(p.value, '[A-Za-z]') AND len(list_distinct(string_split(p.value, ''))) >= 10 AND NOT regexp_matches(lower(p.value), '{PLACEHOLDERS}') AS looks
    FROM p LEFT JOIN freq USING (value) LEFT JOIN wide USING (value)),
spans AS (SELECT r, start AS a, ord AS o, stop AS z, kind || ':' || start || ':' || stop AS s, true AS base FROM c WHERE ok AND kind IN ('assign', 'access', 'hex')
    UNION ALL SELECT DISTINCT r, v_start, 4, stop, 'live:' || v_start || ':' || stop, false FROM c WHERE looks AND NOT example),
joined AS (SELECT r, coalesce(string_agg(s, ',' ORDER BY a, o, z) FILTER (base), '') AS base, string_agg(s, ',' ORDER BY a, o, z) AS every, count(*) FILTER (NOT base) AS n_live FROM spans GROUP BY r),
counts AS (SELECT r, count(*) FILTER (ok AND kind = 'assign') AS n_assign, count(*) FILTER (ok AND kind = 'access') AS n_access, count(*) FILTER (ok AND kind = 'hex') AS n_hex,
    count(*) FILTER (ok AND example) AS n_example, max(n_owners) AS max_owners, max(n_repos) AS max_repos FROM c GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans,
    coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example, coalesce(max_owners, 0) AS max_owners, coalesce(max_repos, 0) AS max_repos
FROM t LEFT JOIN joined USING (r) LEFT JOIN counts USING (r)
"""
