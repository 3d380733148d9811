"""Document cleaning inside the document row: line classes, headers, citations, quality.

A page's lines are an array in its document's row; repeated lines are found by
sorting their keys there. No exchange is needed however large the corpus is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lectern.functions import text as T
from lectern.functions.arrays import keep_first, let, repeated_values

# Headings that start the references, and lines that are publisher furniture.
REFERENCES = "(?i)^(?:references|bibliography|works cited|citations)$"
FURNITURE = f"(?i)^(?:case{T.WS}+id{T.WS}+[A-Za-z0-9_]+|noname{T.WS}+manuscript|will{T.WS}+be{T.WS}+inserted{T.WS}+by{T.WS}+the{T.WS}+editor)$"
# Inline and parenthetical citation shapes.
INLINE_CITATION = (
    r"\[(?:[0-9]+(?:\s*[,–-]\s*[0-9]+)*|[A-Z][a-zA-Z]+(?:\s+et\s+al\.?)?,?\s*[0-9]{4})\]".replace(r"\s", T.WS)
)
_AUTHOR = r"[A-Z][a-zA-Z]+(?:\s+(?:et\s+al\.?|&\s+[A-Z][a-zA-Z]+))?,\s*[0-9]{4}"
PAREN_CITATION = (r"\((?:" + _AUTHOR + r")(?:;\s*(?:" + _AUTHOR + r"))*\)").replace(r"\s", T.WS)
NUMERIC_CITATION = r"\[(?:[0-9]+(?:\s*[,–-]\s*[0-9]+)*)\]".replace(r"\s", T.WS_LIST)
HEADER_MIN, HEADER_MAX = 4, 140
PAGE_MARK = "\x1e\f\x1e"


# Digits and odd blanks; letters and signs of ASCII fail at the first look.
_SHORTENED = "[[^ -/:-~]&&[0-9" + T.WS_LIST[1:].replace(" ", "") + "]"


def header_key(line: Column) -> Column:
    """Key of a tidy line when it can be short enough for a header, else null.

    Only digits and odd blanks make a key shorter than its line, so other long
    lines skip the work.
    """
    could_be = (F.char_length(line) <= HEADER_MAX) | line.rlike(_SHORTENED)
    return F.when(could_be, T.line_key(line))


def tighten(text: Column) -> Column:
    """No white space before punctuation."""
    return F.regexp_replace(text, T.WS + "+([.,;:!?])", "$1")


def strip_citations(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, INLINE_CITATION, ""), PAREN_CITATION, "")


def count_citations(text: Column) -> Column:
    inline = F.regexp_count(text, F.lit(INLINE_CITATION))
    return inline + F.regexp_count(F.regexp_replace(text, INLINE_CITATION, ""), F.lit(PAREN_CITATION))


def strip_citation_noise(text: Column) -> Column:
    return T.strip(tighten(F.regexp_replace(text, NUMERIC_CITATION, "")))


HYPHEN_BREAK = r"(\p{L})-\n(\p{Ll})"


def join_hyphens(text: Column) -> Column:
    """Words cut at the end of a line made whole; texts without such a line end are not searched letter by letter."""
    return let(text, lambda t: F.when(F.contains(t, F.lit("-\n")), F.regexp_replace(t, HYPHEN_BREAK, "$1$2")).otherwise(t))


def count_hyphens(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("-\n")), F.regexp_count(text, F.lit(HYPHEN_BREAK))).otherwise(0)


def normalise_layout(text: Column, aggressive: bool) -> Column:
    """Join hyphen breaks and continued lines, squeeze blanks and empty lines."""
    t = F.replace(text, F.lit("\t"), F.lit(" "))
    t = join_hyphens(t)
    t = F.regexp_replace(t, r"\n(?=[a-z(])(?<=[a-z0-9,;:]\n)", " ")
    t = F.regexp_replace(t, "[ ]{2,}", " ")
    t = F.regexp_replace(t, r"\n{3,}" if aggressive else r"\n{4,}", "\n\n")
    return T.strip(tighten(t))


def clean_lines(text: Column) -> Column:
    """Line structs of a composed, readable text with what happens to each.

    kinds: blank, page_number, furniture, repeated (a later copy), noise, text.
    """
    def classify(lines: Column) -> Column:
        keys = F.filter(
            F.transform(lines, lambda l: l["raw_key"]), lambda k: F.char_length(k).between(HEADER_MIN, HEADER_MAX)
        )

        def with_repeats(repeats: Column) -> Column:
            def line(raw: Column, i: Column) -> Column:
                return let(
                    T.collapse_line_phrase(raw["tidy"]),
                    lambda t: F.struct(
                        i.alias("no"),
                        t.alias("text"),
                        F.when(t == raw["tidy"], raw["raw_key"]).otherwise(header_key(t)).alias("key"),
                        F.when(t == "", "blank")
                        .when(T.is_page_number(t), "page_number")
                        .when(t.rlike(FURNITURE), "furniture")
                        .otherwise("text")
                        .alias("kind"),
                    ),
                )

            rows = F.transform(lines, line)

            def drop_copies(rows: Column) -> Column:
                def copied(r: Column) -> Column:
                    return F.coalesce(
                        (r["kind"] == "text")
                        & (F.char_length(r["text"]) <= HEADER_MAX)
                        & F.array_contains(repeats, r["key"]),
                        F.lit(False),
                    )

                firsts = F.transform(keep_first(F.filter(rows, copied), lambda r: r["key"]), lambda r: r["no"])
                return let(
                    firsts,
                    lambda f: F.transform(
                        rows,
                        lambda r: r.withField(
                            "kind",
                            F.when(copied(r) & ~F.array_contains(f, r["no"]), "repeated")
                            .when((r["kind"] == "text") & T.encoding_noise(r["text"]), "noise")
                            .otherwise(r["kind"]),
                        ),
                    ),
                )

            return F.when(F.size(repeats) > 0, let(rows, drop_copies)).otherwise(
                F.transform(
                    rows,
                    lambda r: r.withField(
                        "kind", F.when((r["kind"] == "text") & T.encoding_noise(r["text"]), "noise").otherwise(r["kind"])
                    ),
                )
            )

        return let(repeated_values(keys, 3), with_repeats)

    def keyed(raw: Column) -> Column:
        return let(T.tidy_line(raw), lambda t: F.struct(t.alias("tidy"), header_key(t).alias("raw_key")))

    return let(F.transform(F.split(text, "\n"), keyed), classify)


def _count(lines: Column, *kinds: str) -> Column:
    return F.size(F.filter(lines, lambda l: l["kind"].isin(*kinds)))


def quality(original: Column, cleaned: Column, corrupt: Column, repeated: Column) -> Column:
    """Quality struct of a cleaned text against its source."""
    def judge(r: Column) -> Column:
        source_lines = F.greatest(F.lit(1), F.size(F.split(original, "\r?\n")))
        penalty = F.least(F.lit(0.32), (corrupt + repeated * 0.35) / source_lines)
        length = F.char_length(cleaned)
        retention = F.least(F.lit(1.0), length / F.greatest(F.lit(400.0), F.char_length(original) * 0.28))
        score = F.greatest(
            F.lit(0.0),
            F.least(
                F.lit(1.0),
                1
                - r["suspicious"] * 2.5
                - F.greatest(F.lit(0.0), r["greek"] - 0.08) * 1.2
                - F.greatest(F.lit(0.0), 0.62 - r["readable"]) * 0.9
                - penalty
                - F.greatest(F.lit(0.0), 0.45 - retention) * 0.45,
            ),
        )
        return let(
            score,
            lambda s: F.struct(
                s.alias("score"),
                ((s >= 0.72) & (length >= 250)).alias("passed"),
                r["suspicious"].alias("suspicious"),
                r["greek"].alias("greek"),
                r["readable"].alias("readable"),
                corrupt.alias("corrupt_lines"),
                repeated.alias("repeated_lines"),
                F.regexp_count(original, F.lit(T.BROKEN)).alias("replacement_chars"),
                F.array_compact(
                    F.array(
                        F.when(corrupt > 0, F.concat(corrupt.cast("string"), F.lit(" corrupt or encoding-noise lines were removed."))),
                        F.when(repeated > 0, F.concat(repeated.cast("string"), F.lit(" repeated header/footer lines were removed."))),
                        F.when(r["suspicious"] > 0.04, F.lit("The remaining text still contains an unusual symbol ratio.")),
                        F.when(r["readable"] < 0.6, F.lit("The extracted text has a low readable-character ratio.")),
                        F.when(length < 250, F.lit("Too little usable text remains after cleaning.")),
                    )
                ).alias("warnings"),
            ),
        )

    size = F.char_length(cleaned)

    def ratios(rest: Column) -> Column:
        visible = size - (F.char_length(rest) - T.visible_length(rest))
        return F.struct(
            F.least(F.lit(1.0), F.when(size > 0, T.corrupt_count(rest) / size).otherwise(0.0)).alias("suspicious"),
            T.greek_ratio(cleaned).alias("greek"),
            F.when(visible > 0, (size - F.char_length(rest)) / visible).otherwise(0.0).alias("readable"),
        )

    return let(let(T.residue(cleaned), ratios), judge)


def joined_text(lines: Column) -> Column:
    """Text of the kept lines: breaks joined, blanks squeezed, noisy remains dropped."""
    kept = F.transform(F.filter(lines, lambda l: l["kind"].isin("blank", "text")), lambda l: l["text"])
    t = F.array_join(kept, "\n")
    t = join_hyphens(t)
    # A letter joined to the line before does not begin the next joint, so the search goes on behind it.
    continued = lambda x: F.regexp_replace(x, r"([a-z,;])\n([a-z])", "$1 $2")
    t = let(t, lambda x: F.when(x.rlike(r"\n(?<=[a-z,;]\n)[a-z]"), continued(x)).otherwise(x))
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    t = T.strip(tighten(t))
    second = F.filter(F.split(t, "\n"), lambda l: ~T.encoding_noise(T.tidy_line(l)))
    return T.strip(F.regexp_replace(F.array_join(second, "\n"), r"\n{3,}", "\n\n"))


def reliable(text: Column, judged: bool = True) -> Column:
    """Second cleaning pass of a composed text: text, quality and removal counts; without quality where nothing reads it."""
    def clean(source: Column) -> Column:
        def report(lines: Column) -> Column:
            corrupt = _count(lines, "noise")
            repeated = _count(lines, "repeated", "furniture")
            return let(
                joined_text(lines),
                lambda t: F.struct(
                    t.alias("text"),
                    *([quality(source, t, corrupt, repeated).alias("quality")] if judged else []),
                    corrupt.alias("corrupt_lines"),
                    repeated.alias("repeated_lines"),
                    _count(lines, "page_number").alias("page_numbers"),
                ),
            )

        return let(clean_lines(source), report)

    return let(T.drop_unreadable(T.unix_newlines(text)), clean)


def clean_text_reliably(docs: DataFrame, text: str = "text", out: str = "clean") -> DataFrame:
    """Add the cleaned text struct; compatibility composition runs once per row."""
    return docs.withColumn("_nfkc", T.nfkc(F.col(text))).withColumn(out, reliable(F.col("_nfkc"))).drop("_nfkc")


def page_lines(pages: Column, references: str = REFERENCES) -> Column:
    """Every line of every page with its class, in order.

    kinds: page_number, repeated (later copy of a running header), display
    (after the references heading), analysis.
    """
    def classify(ps: Column) -> Column:
        split = F.flatten(
            F.transform(
                ps,
                lambda p: F.transform(
                    F.split(T.unix_newlines(p["raw_text"]), "\n"),
                    lambda l: let(
                        T.tidy_line(l),
                        lambda t: F.struct(p["page_no"].alias("page_no"), t.alias("text"), header_key(t).alias("key")),
                    ),
                ),
            )
        )

        def headers_of(lines: Column) -> Column:
            short = F.filter(lines, lambda l: F.char_length(l["key"]).between(HEADER_MIN, HEADER_MAX))
            once = F.array_distinct(
                F.transform(short, lambda l: F.concat(l["page_no"].cast("string"), F.lit(":"), l["key"]))
            )
            per_page = F.transform(once, lambda k: F.regexp_replace(k, "^[0-9]+:", ""))
            return F.when(F.size(ps) >= 2, repeated_values(per_page, need)).otherwise(F.array().cast("array<string>"))

        need = F.greatest(F.lit(2), F.ceil(F.size(ps) * 0.55).cast("int"))

        def mark(lines: Column, heads: Column) -> Column:
            numbered = F.transform(lines, lambda l, i: l.withField("no", i))
            cut = F.array_position(F.transform(lines, lambda l: l["text"].rlike(references)), True)

            def kinds(rows: Column, at: Column) -> Column:
                def header(r: Column) -> Column:
                    return F.coalesce(
                        F.array_contains(heads, r["key"]) & (r["text"] != "") & ~T.is_page_number(r["text"]), F.lit(False)
                    )

                firsts = F.transform(keep_first(F.filter(rows, header), lambda r: r["key"]), lambda r: r["no"])
                return let(
                    firsts,
                    lambda f: F.transform(
                        rows,
                        lambda r: r.withField(
                            "kind",
                            F.when(T.is_page_number(r["text"]), "page_number")
                            .when(header(r) & ~F.array_contains(f, r["no"]), "repeated")
                            .when((at > 0) & (r["no"] >= at - 1), "display")
                            .otherwise("analysis"),
                        ),
                    ),
                )

            return let(cut, lambda at: let(numbered, lambda rows: kinds(rows, at)))

        return let(split, lambda lines: let(headers_of(lines), lambda heads: mark(lines, heads)))

    return let(pages, classify)


def clean_documents(docs: DataFrame, references: str = REFERENCES, judged: bool = False) -> DataFrame:
    """Clean raw documents(doc_id, raw_text[, pages]) page by page.

    Adds display_text, analysis_text, source_pages and stats; with ``judged``, pages carry the quality of both their texts.
    """
    from lectern.sources.ingest import page_texts

    if "pages" in docs.columns:
        given = page_texts(F.col("raw_text"), F.col("pages"))
    else:
        given = page_texts(F.col("raw_text"))
    # Composition needs one Arrow pass, so pages travel as one string and are cut again.
    df = (
        docs.withColumn("_given", given)
        .withColumn("_flat", T.nfkc(F.array_join(F.transform("_given", lambda p: p["raw_text"]), PAGE_MARK)))
        .withColumn(
            "_pages",
            F.zip_with(
                # Pages go by position: given numbers may repeat.
                F.transform("_given", lambda g, i: F.struct(i.alias("place"), g["page_no"].alias("given_no"))),
                F.split("_flat", PAGE_MARK),
                lambda g, t: F.struct(g["place"].alias("page_no"), t.alias("raw_text"), g["given_no"].alias("given_no")),
            ),
        )
        .withColumn("_lines", page_lines(F.col("_pages"), references))
    )

    def page(p: Column, k: Column, every: Column, cuts: Column) -> Column:
        # Lines stand in order of pages, so a page's own are one slice.
        mine = F.slice(every, F.get(cuts, k) + 1, F.get(cuts, k + 1) - F.get(cuts, k))

        def build(lines: Column) -> Column:
            shown = F.array_join(
                F.transform(F.filter(lines, lambda l: l["kind"].isin("display", "analysis")), lambda l: l["text"]), "\n"
            )
            read = F.array_join(
                F.transform(F.filter(lines, lambda l: l["kind"] == "analysis"), lambda l: l["text"]), "\n"
            )
            # Without references, citations and wide gaps both readings are one text, cleaned once: the pass depends on nothing else.
            laid = F.array_distinct(F.array(normalise_layout(shown, False), normalise_layout(strip_citations(read), True)))
            return F.struct(
                p["given_no"].alias("page_no"),
                F.transform(laid, lambda t: reliable(t, judged)).alias("readings"),
                count_citations(read).alias("citations"),
                count_hyphens(shown).alias("hyphens"),
            )

        return let(mine, build)

    sizes = F.transform("_pages", lambda p: F.size(F.split(T.unix_newlines(p["raw_text"]), "\n")))
    cuts = F.aggregate(sizes, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    both = let(F.struct(F.col("_lines").alias("lines"), cuts.alias("cuts")), lambda x: F.transform("_pages", lambda p, k: page(p, k, x["lines"], x["cuts"])))
    df = df.withColumn("_built", both)
    shown_of = lambda b: F.element_at(b["readings"], 1)
    read_of = lambda b: F.element_at(b["readings"], -1)
    # Pages per document are few, so running offsets fold inside the row.
    placed = F.aggregate(
        F.transform(
            "_built",
            lambda b: F.struct(
                b["page_no"].alias("page_no"), shown_of(b)["text"].alias("display_text"),
                read_of(b)["text"].alias("analysis_text"),
            ),
        ),
        F.array().cast("array<struct<page_no:int,display_text:string,analysis_text:string,start:int,end:int>>"),
        lambda acc, b: F.concat(
            acc,
            F.array(
                let(
                    F.when(F.size(acc) > 0, F.element_at(acc, -1)["end"] + 2).otherwise(F.lit(0)),
                    lambda at: F.struct(
                        b["page_no"].alias("page_no"), b["display_text"].alias("display_text"),
                        b["analysis_text"].alias("analysis_text"), at.alias("start"),
                        (at + F.char_length(b["display_text"])).alias("end"),
                    ),
                )
            ),
        ),
    )

    def total(value) -> Column:
        return F.aggregate("_built", F.lit(0), lambda acc, b: acc + value(b))

    def non_empty(field: str) -> Column:
        parts = F.filter(F.transform("source_pages", lambda p: p[field]), lambda t: t != "")
        return T.strip(F.array_join(parts, "\n\n"))

    lines = F.col("_lines")
    if judged:
        placed = F.zip_with(placed, "_built", lambda p, b: p.withField("display_quality", shown_of(b)["quality"]).withField("analysis_quality", read_of(b)["quality"]))
    df = df.withColumn("source_pages", placed)
    df = df.withColumn("display_text", non_empty("display_text")).withColumn("analysis_text", non_empty("analysis_text"))
    stats = F.struct(
        F.char_length("raw_text").alias("raw_length"),
        F.char_length("analysis_text").alias("clean_length"),
        (_count(lines, "page_number") + total(lambda b: shown_of(b)["page_numbers"])).alias("page_numbers"),
        total(lambda b: b["citations"]).alias("citations"),
        F.size(F.filter(lines, lambda l: (l["kind"] == "display") & (l["text"] != ""))).alias("reference_lines"),
        F.exists(lines, lambda l: l["text"].rlike(references)).alias("references_cut"),
        (_count(lines, "repeated") + total(lambda b: shown_of(b)["repeated_lines"])).alias("headers"),
        total(lambda b: b["hyphens"]).alias("hyphens"),
    )
    return df.withColumn("stats", stats).drop("_given", "_flat", "_pages", "_lines", "_built")


# ---- corpus-wide forms: pages of one unit are separate rows ---------------------------------------


def running_headers(pages: DataFrame, unit: str, page: str, text: str, share: float = 0.55) -> DataFrame:
    """Line keys on at least max(2, ``share``) of a unit's pages.

    Keys are made distinct inside each page row, so counting is one aggregation
    with map-side combine: a unit with most of the rows still spreads out.
    """
    keys = F.array_distinct(
        F.filter(
            F.transform(F.split(T.unix_newlines(F.col(text)), "\n"), lambda l: header_key(T.tidy_line(l))),
            lambda k: F.char_length(k).between(HEADER_MIN, HEADER_MAX),
        )
    )
    counts = (
        pages.select(unit, F.explode(keys).alias("line_key")).groupBy(unit, "line_key").agg(F.count("*").alias("pages"))
    ).filter(F.col("pages") >= 2)
    sizes = pages.groupBy(unit).agg(F.count("*").alias("_total"))
    return counts.join(sizes, unit).filter(
        F.col("pages") >= F.greatest(F.lit(2), F.ceil(F.col("_total") * share))
    ).drop("_total")


def repeated_lines(docs: DataFrame, key: str, text: str, times: int = 3) -> DataFrame:
    """Line keys seen at least ``times`` times inside one document."""
    keys = F.filter(
        F.transform(F.split(T.unix_newlines(F.col(text)), "\n"), lambda l: header_key(T.tidy_line(l))),
        lambda k: F.char_length(k).between(HEADER_MIN, HEADER_MAX),
    )
    return docs.select(key, F.explode(repeated_values(keys, times)).alias("line_key"))


def first_header_only(lines: DataFrame, headers: DataFrame, unit: str, order: list[str]) -> DataFrame:
    """Lines(unit, line_key, ...) without later copies of the listed headers."""
    place = F.struct(*order)
    first = lines.join(headers.select(unit, "line_key"), [unit, "line_key"]).groupBy(unit, "line_key").agg(F.min(place).alias("_first"))
    return lines.join(first, [unit, "line_key"], "left").filter(F.col("_first").isNull() | (place == F.col("_first"))).drop("_first")


def running_total(df: DataFrame, unit: str, order: str, value: Column, block: int = 4096) -> DataFrame:
    """Exclusive running sum of ``value`` per unit along the integer ``order``.

    Two levels: totals per block of consecutive order values, then sums inside
    a block. No task ever holds a whole unit, only one block or the block totals.
    """
    marked = df.withColumn("_v", value).withColumn("_block", F.floor(F.col(order) / block))
    totals = marked.groupBy(unit, "_block").agg(F.sum("_v").alias("_sum"))
    before = Window.partitionBy(unit).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(unit, "_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(unit, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        marked.withColumn("_in", F.coalesce(F.sum("_v").over(inside), F.lit(0)))
        .join(totals, [unit, "_block"])
        .withColumn("start", F.col("_base") + F.col("_in"))
        .drop("_v", "_block", "_in", "_base")
    )
