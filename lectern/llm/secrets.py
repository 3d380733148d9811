"""Secrets in texts: strong patterns alone, weak ones only beside their counterparts.

Strong parts (assignments, access keys, long hex runs) are reported wherever they are. Weak parts
(account names, opaque runs, endpoints) are reported if a part they complement starts or ends
within ``SCOPE`` code points: names need a secret, opaque runs a name or an access key, endpoints
any strong part. Parts meet in an interval join on the document and on scope-wide stretches.

Positions come from SQL functions only: the pieces between matches and the matches themselves
alternate, so a running sum of their lengths places each match.

Defined results: a null or empty text has no spans (the digest of an empty list); repeated rows
and repeated ids are scanned each on its own; an empty table gives no rows; further columns of
the table are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from lectern.llm.shared import id_and_text, staged

SCOPE = 256


def either_case(words: str) -> str:
    """A pattern that accepts the ASCII letters of ``words`` in either case."""
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in words)


_ASSIGNED = r"""["']?\x20*[:=]\x20*["']?"""


@dataclass(frozen=True)
class Kind:
    """A kind of part; ``group`` is what must have ``least`` code points. Roles: N name, S secret, E endpoint."""

    name: str
    pattern: str
    group: int
    least: int
    role: str
    strong: bool


# The patterns of the parts.
KINDS = (
    Kind("assign", f"({either_case('password|passwd|secret|token|api_?key')}){_ASSIGNED}([A-Za-z0-9+/_.=-]+)", 2, 8, "S", True),
    Kind("access", "AKIA[A-Z0-9]+", 0, 16, "N", True),
    Kind("hex", "[0-9a-f]{32,}", 0, 32, "S", True),
    Kind("name", f"({either_case('access_?key_?id|client_?id|account|user_?name|login')}){_ASSIGNED}([A-Za-z0-9_.@-]+)", 2, 4, "N", False),
    Kind("opaque", "[A-Za-z0-9+/]{40,}", 0, 40, "S", False),
    Kind("endpoint", "https?://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+", 0, 12, "E", False),
)
#: What must be there before a pattern is worth a search.
_HINTS = {"access": "AKIA", "endpoint": "://"}


def _pieces(text: Column, number: int, kind: Kind) -> Column:
    """Lengths of the text before each match, of the match and of its group; the last has the rest alone."""
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.group))
    lengths = F.arrays_zip(*[F.transform(a, F.length).alias(n) for a, n in ((F.split(text, kind.pattern), "before"), (matches, "size"), (groups, "inner"))])
    found = F.transform(lengths, lambda x, k: F.struct(F.lit(number).alias("kind"), k.alias("place"), x["before"].alias("before"), x["size"].alias("size"), x["inner"].alias("inner")))
    there = text.contains(_HINTS[kind.name]) if kind.name in _HINTS else text.rlike(kind.pattern)
    return F.when(there, found)


def find_parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows (row_id, doc_id) of the table, and all parts: row_id, kind, start, stop."""
    text = F.coalesce(F.col("text"), F.lit(""))
    nothing = F.array().cast("array<struct<kind:int,place:int,before:int,size:int,inner:int>>")
    rows = id_and_text(docs, id_col, text_col).select(
        F.monotonically_increasing_id().alias("row_id"), "doc_id", F.concat(*[F.coalesce(_pieces(text, k, kind), nothing) for k, kind in enumerate(KINDS)]).alias("found")
    )
    rows = staged(rows, "secret-parts")
    pieces = rows.where(F.size("found") > 0).select("row_id", F.inline("found"))
    so_far = Window.partitionBy("row_id", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    placed = pieces.withColumn("stop", F.sum(F.col("before") + F.coalesce("size", F.lit(0))).over(so_far))
    least = F.element_at(F.array(*[F.lit(k.least) for k in KINDS]), F.col("kind") + 1)
    parts = placed.where(F.col("inner") >= least).select("row_id", "kind", (F.col("stop") - F.col("size")).alias("start"), "stop")
    return rows.select("row_id", "doc_id"), parts


def link_weak(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak parts that have a counterpart within ``scope`` and overlap no strong part."""
    role = F.element_at(F.array(*[F.lit(k.role) for k in KINDS]), F.col("kind") + 1)
    strong = F.element_at(F.array(*[F.lit(k.strong) for k in KINDS]), F.col("kind") + 1)
    known = parts.withColumn("role", role).withColumn("strong", strong)
    # Every stretch that a part's reach touches. A part that is longer than the scope touches
    # more, in proportion to its own length.
    reach = F.sequence(F.floor((F.col("start") - scope) / scope), F.floor((F.col("stop") + scope) / scope))
    sides = known.select("row_id", *[F.col(c).alias(f"other_{c}") for c in ("kind", "start", "stop", "role", "strong")], F.explode(reach).alias("stretch"))
    weak = known.where(~F.col("strong")).withColumn("stretch", F.explode(F.sequence(F.floor(F.col("start") / scope), F.floor(F.col("stop") / scope))))
    near = (F.col("other_start") <= F.col("stop") + scope) & (F.col("start") <= F.col("other_stop") + scope)
    overlap = (F.col("other_start") < F.col("stop")) & (F.col("start") < F.col("other_stop"))
    complements = (
        ((F.col("role") == "N") & (F.col("other_role") == "S"))
        | ((F.col("role") == "S") & (F.col("other_role") == "N"))
        | ((F.col("role") == "E") & F.col("other_strong"))
    )
    weak, sides = weak.alias("weak"), sides.alias("sides")
    same = (F.col("weak.row_id") == F.col("sides.row_id")) & (F.col("weak.stretch") == F.col("sides.stretch"))
    linked = weak.join(sides, same & near & ~overlap & complements, "left_semi").select("row_id", "kind", "start", "stop").distinct()
    covered = weak.join(sides, same & overlap & F.col("other_strong"), "left_semi").select("row_id", "kind", "start", "stop").distinct()
    return linked.join(covered, ["row_id", "kind", "start", "stop"], "left_anti")


def find_secrets(docs: DataFrame, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id and ``found``, an array of (start, kind number, stop) in that order."""
    rows, parts = find_parts(docs, id_col, text_col)
    strong = parts.where(F.col("kind").isin([k for k, kind in enumerate(KINDS) if kind.strong]))
    all_spans = strong.select("row_id", "kind", "start", "stop").unionByName(link_weak(parts, scope))
    found = all_spans.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "stop"))).alias("found"))
    nothing = F.array().cast("array<struct<start:bigint,kind:int,stop:bigint>>")
    return rows.join(found, "row_id", "left").select("doc_id", F.coalesce("found", nothing).alias("found"))


def joined_spans(found: Column) -> Column:
    """kind:start:stop of every span, comma-joined."""
    names = F.array(*[F.lit(k.name) for k in KINDS])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["stop"].cast("string"))), ",")


def _is_kind(number: int):
    return lambda span: span["kind"] == number


def digest(secrets: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the strong spans, and all spans as text."""
    base = F.filter("found", lambda x: x["kind"] < sum(k.strong for k in KINDS))
    counts = [F.size(F.filter("found", _is_kind(k))).cast("long").alias(f"n_{kind.name}") for k, kind in enumerate(KINDS)]
    return secrets.select("doc_id", *counts, F.sha2(joined_spans(base), 256).alias("base_sha256"), joined_spans(F.col("found")).alias("spans"))


def _sql_parts() -> str:
    return "\n  UNION ALL\n".join(
        f"""  SELECT doc_id, {k} AS kind, place, length(before) AS before, length(match) AS size, length(inner_) AS inner_ FROM (
    SELECT doc_id, unnest(string_split_regex(t, p)) AS before, unnest(regexp_extract_all(t, p, 0)) AS match,
           unnest(regexp_extract_all(t, p, {kind.group})) AS inner_, generate_subscripts(string_split_regex(t, p), 1) AS place
    FROM (SELECT doc_id, coalesce(text, '') AS t, '{kind.pattern.replace("'", "''")}' AS p FROM documents))"""
        for k, kind in enumerate(KINDS)
    )


def oracle_sql(scope: int = SCOPE) -> str:
    """The digest of ``documents`` in DuckDB SQL."""
    cases = lambda values: "CASE kind " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)) + " END"
    n_strong = sum(k.strong for k in KINDS)
    spans = "coalesce(string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind, stop){}, '')"
    counts = ", ".join(f"count(*) FILTER (kind = {k}) AS n_{kind.name}" for k, kind in enumerate(KINDS))
    return f"""WITH pieces AS (
{_sql_parts()}
), placed AS (
  SELECT *, sum(before + coalesce(size, 0)) OVER (PARTITION BY doc_id, kind ORDER BY place) AS stop FROM pieces
), parts AS (
  SELECT doc_id, kind, CAST(stop - size AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, {cases([f"'{k.name}'" for k in KINDS])} AS name,
         {cases([f"'{k.role}'" for k in KINDS])} AS role, kind < {n_strong} AS strong
  FROM placed WHERE inner_ >= {cases([k.least for k in KINDS])}
), spans AS (
  SELECT * FROM parts p WHERE strong OR (
    EXISTS (SELECT 1 FROM parts o WHERE o.doc_id = p.doc_id AND o.start <= p.stop + {scope} AND p.start <= o.stop + {scope}
            AND NOT (o.start < p.stop AND p.start < o.stop)
            AND ((p.role = 'N' AND o.role = 'S') OR (p.role = 'S' AND o.role = 'N') OR (p.role = 'E' AND o.strong)))
    AND NOT EXISTS (SELECT 1 FROM parts o WHERE o.doc_id = p.doc_id AND o.strong AND o.start < p.stop AND p.start < o.stop))
), per_doc AS (
  SELECT doc_id, {counts}, {spans.format(" FILTER (strong)")} AS base, {spans.format("")} AS spans FROM spans GROUP BY doc_id
)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k.name}, 0) AS n_{k.name}" for k in KINDS)}, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans
FROM documents d LEFT JOIN per_doc USING (doc_id)"""
