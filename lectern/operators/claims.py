"""Evidence-backed claims from annotated sentences, their validation and headline fields.

Each extractor maps the sentence array of one document to a claim array; the
union keeps the first of equal claims. All of it stays in the document's row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lectern.functions import lexicon as L
from lectern.functions import text as T
from lectern.functions.arrays import first_where, grouped, keep_first, let, top_n
from lectern.functions.numbers import plain_number

# Claim confidences by extractor.
CONFIDENCE = {
    "problem_signal": 0.86, "problem": 0.62, "method_context": 0.93, "method": 0.72, "tool": 0.88,
    "data_named": 0.95, "data": 0.76, "sample": 0.9, "band": 0.97, "result_metric": 0.93, "result": 0.72,
    "metric": 0.9, "signal": 0.82, "definition": 0.74,
}
PREDICATES = {"contribution": "contributes", "limitation": "is limited by", "future_work": "proposes"}


def claim(s, kind, subject, predicate, obj, confidence, metric=None, value=None, unit=None, qualifier=None) -> Column:
    def lit(v, t="string"):
        return (v if isinstance(v, Column) else F.lit(v)).cast(t)

    return F.struct(
        lit(kind).alias("type"), lit(subject).alias("subject"), lit(predicate).alias("predicate"),
        T.strip(lit(obj)).alias("object"), lit(metric).alias("metric"), lit(value, "double").alias("value"),
        lit(unit).alias("unit"), lit(qualifier).alias("qualifier"), lit(confidence, "double").alias("confidence"),
        s["no"].alias("sent_no"), s["text"].alias("evidence"), s["section"].alias("section"),
        s["page"].cast("int").alias("page"),
    )


def problem_claims(sentences: Column, signals=None) -> Column:
    """Best-scored signal sentence of the opening sections, else their first sentence."""
    signals = signals or L.SIGNALS["problem"]
    scoped = F.filter(
        sentences, lambda s: s["role"].isin("abstract", "background") | s["section"].rlike("(?i)introduction")
    )

    def pick(inside: Column) -> Column:
        flagged = F.filter(inside, lambda s: T.contains_signal(s["text"], signals))
        best = F.get(top_n(flagged, lambda s: F.struct((-s["score"]).alias("a"), s["no"].alias("b")), 1), F.lit(0))
        chosen = F.coalesce(best, F.get(inside, F.lit(0)))
        return let(
            chosen,
            lambda s: F.when(
                s.isNotNull(),
                F.array(
                    claim(
                        s, "problem", "Document", "addresses", s["text"],
                        F.when(T.contains_signal(s["text"], signals), CONFIDENCE["problem_signal"]).otherwise(
                            CONFIDENCE["problem"]
                        ),
                    )
                ),
            ),
        )

    return let(scoped, pick)


def _of_type(s: Column, *kinds: str) -> Column:
    return F.filter(s["entities"], lambda e: e["type"].isin(*kinds))


def longest_entities(entities: Column, n: int = 2) -> Column:
    """Longest entities, ties in order of discovery."""
    ranked = F.sort_array(
        F.transform(entities, lambda e, i: F.struct((-F.char_length(e["text"])).alias("a"), i.alias("i"), e.alias("e")))
    )
    return F.transform(F.slice(ranked, 1, n), lambda r: r["e"])


def method_claims(sentences: Column, signals=None) -> Column:
    signals = signals or L.SIGNALS["method"]

    def of(s: Column) -> Column:
        context = T.contains_signal(s["text"], signals) | s["role"].isin("method", "implementation")
        score = F.when(context, CONFIDENCE["method_context"]).otherwise(CONFIDENCE["method"])
        return F.transform(
            longest_entities(_of_type(s, "METHOD", "ALGORITHM")),
            lambda e: claim(s, "method", "Document", "uses", e["text"], score),
        )

    return F.flatten(F.transform(sentences, of))


def tool_claims(sentences: Column) -> Column:
    def of(s: Column) -> Column:
        made = s["text"].rlike("(?i)implemented|packaged|toolset|software")
        return F.transform(
            _of_type(s, "TOOL"),
            lambda e: claim(
                s, "tool", "Document", F.when(made, "implements with").otherwise("mentions"), e["text"], CONFIDENCE["tool"]
            ),
        )

    return F.flatten(F.transform(sentences, of))


def data_source_claims(sentences: Column, wording: str = "dataset|data set|corpus|benchmark") -> Column:
    """Named data sources; names of four letters or less need data-set wording."""

    def of(s: Column) -> Column:
        worded = F.lower(s["text"]).rlike(f"{T.BEFORE}(?:{wording}){T.AFTER}")
        named = F.filter(_of_type(s, "DATASET"), lambda e: worded | (F.char_length(e["text"]) > 4))
        return F.transform(
            named,
            lambda e: claim(
                s, "data_source", "Document", "uses data source", e["text"],
                F.when(worded, CONFIDENCE["data_named"]).otherwise(CONFIDENCE["data"]),
            ),
        )

    return F.flatten(F.transform(sentences, of))


def sample_pattern(nouns: str) -> str:
    return f"(?i){T.BEFORE}([0-9]{{1,6}}){T.WS}+((?:[A-Za-z][A-Za-z-]*{T.WS}+){{0,4}})({nouns}){T.AFTER}"


def sample_claims(sentences: Column, nouns: str = L.SAMPLE_NOUNS) -> Column:
    """First "<number> ... <counted noun>" of a sentence."""
    pattern = sample_pattern(nouns)

    def of(s: Column) -> Column:
        # A number begins behind its first digit, so the pattern need not be tried at every letter.
        hit = F.when(s["text"].rlike("[0-9]"), F.regexp_extract(s["text"], pattern, 0))

        def found(h: Column) -> Column:
            def made(g: Column) -> Column:
                words = T.squeeze_strip(F.concat(g["words"], g["noun"]))
                used = s["text"].rlike("(?i)selected|identified|included|trial|used|assessed")
                return claim(
                    s, "sample", "Evaluation", F.when(used, "uses sample").otherwise("mentions sample"),
                    F.concat(g["number"], F.lit(" "), words), CONFIDENCE["sample"],
                    value=g["number"].try_cast("double"), unit=F.lower(g["noun"]), qualifier=words,
                )

            parts = F.struct(*[F.regexp_extract(s["text"], pattern, i).alias(name) for i, name in ((1, "number"), (2, "words"), (3, "noun"))])
            return F.transform(F.array(parts), made)

        none = F.filter(F.array(claim(s, "sample", "", "", "", 0.0)), lambda c: F.lit(False))
        return let(hit, lambda h: F.when(h != "", found(h)).otherwise(none))

    return F.flatten(F.transform(sentences, of))


BAND = (
    "(?i)([0-9]+(?:\\.[0-9]+)?)(?:{w}*[-–]{w}*([0-9]+(?:\\.[0-9]+)?))?%{w}+inaccuracy[^.;]*?{b}"
    "(?:achieved{w}+on|on){w}+([0-9]+(?:\\.[0-9]+)?)%{w}+of{w}+projects"
).replace("{w}", T.WS).replace("{b}", T.BEFORE)


def number_labels(low: Column) -> Column:
    """Numbers that are labels of a section, figure, table, equation or reference."""
    return F.regexp_extract_all(
        low, F.lit(f"{T.BEFORE}(?:section|figure|table|equation|reference){T.WS}+([0-9]+(?:\\.[0-9]+)?)"), F.lit(1)
    )


def is_label(number: Column, labels: Column) -> Column:
    return F.array_contains(labels, F.replace(number, F.lit("%"), F.lit("")))


def structural_number(number: Column, low: Column) -> Column:
    """Number is the label of a section, figure, table, equation or reference."""
    return is_label(number, number_labels(low))


def choose_metric(text: Column, detected: Column, order=None) -> Column:
    """First metric of the preference list found in the text, else the longest detected one."""

    def pick(low: Column) -> Column:
        listed = F.coalesce(*[F.when(F.contains(low, F.lit(m)), F.lit(m)) for m in (order or L.METRIC_ORDER)])
        return F.coalesce(listed, F.lower(F.get(longest_entities(detected, 1), F.lit(0))["text"]))

    return let(F.lower(text), pick)


def nearest_number(text: Column, metric: Column, numbers: Column) -> Column:
    """Value of the number closest to the metric mention, else the first percentage, else the first."""
    low = F.lower(text)

    def value(raw: Column) -> Column:
        return F.replace(raw, F.lit("%"), F.lit("")).try_cast("double")

    def pick(places: Column) -> Column:
        ranked = F.sort_array(
            F.transform(
                numbers,
                lambda n, i: F.struct(
                    F.abs(F.instr(places["low"], F.lower(n)) - places["at"]).alias("d"), i.alias("i"), n.alias("n")
                ),
            )
        )
        near = F.get(ranked, F.lit(0))["n"]
        percent = first_where(numbers, lambda n: F.contains(n, F.lit("%")))
        return value(F.when(places["at"] > 0, near).otherwise(F.coalesce(percent, F.get(numbers, F.lit(0)))))

    at = F.coalesce(F.instr(low, F.lower(metric)), F.lit(0))
    return let(F.struct(low.alias("low"), at.alias("at")), pick)


def result_claims(sentences: Column, nouns: str = L.SAMPLE_NOUNS, wording: str = L.RESULT_WORDS, order=None) -> Column:
    """Error-band results first; else a number with a metric or percentage in a result context."""

    def bands(s: Column) -> Column:
        def one(hit: Column) -> Column:
            low, high, share = (F.regexp_extract(hit, BAND, i) for i in (1, 2, 3))
            band = F.when(high != "", F.concat(low, F.lit("-"), high, F.lit("%"))).otherwise(F.concat(low, F.lit("%")))
            number = share.try_cast("double")
            return claim(
                s, "result", "Prediction validation", "reports project proportion",
                F.concat(plain_number(number), F.lit("% of projects had "), band, F.lit(" prediction inaccuracy")),
                CONFIDENCE["band"], metric="prediction inaccuracy", value=number, unit="percent of projects",
                qualifier=F.concat(band, F.lit(" inaccuracy")),
            )

        # The pattern needs a percentage of this word; texts without it are not searched number by number.
        named = F.contains(s["text"], F.lit("%")) & s["text"].rlike("(?i)inaccuracy")
        hits = F.when(named, F.regexp_extract_all(s["text"], F.lit(BAND), F.lit(0))).otherwise(F.array().cast("array<string>"))
        return F.transform(hits, one)

    def general(s: Column) -> Column:
        given = F.transform(_of_type(s, "NUMBER"), lambda e: e["text"])
        unlabelled = lambda ns: let(number_labels(F.lower(s["text"])), lambda labels: F.filter(ns, lambda n: ~is_label(n, labels)))
        numbers = let(given, lambda ns: F.when(F.size(ns) > 0, unlabelled(ns)))

        def with_numbers(x: Column) -> Column:
            metric, ns = x["metric"], x["numbers"]
            percent = F.exists(ns, lambda n: F.contains(n, F.lit("%")))
            context = s["role"].isin(*L.RESULT_ROLES) | s["text"].rlike(f"(?i){T.BEFORE}(?:{wording}){T.AFTER}")
            counted = s["text"].rlike(f"(?i){T.BEFORE}[0-9]{{1,6}}{T.WS}+(?:{nouns}){T.AFTER}")
            wanted = (
                (F.size(ns) > 0)
                & context
                & ~(counted & metric.isNull() & ~percent)
                & (metric.isNotNull() | percent | (s["role"] == "results"))
            )
            number = nearest_number(s["text"], metric, ns)

            def emit(v: Column) -> Column:
                shown = F.concat(plain_number(v), F.lit("%"))
                fixed = F.concat(F.replace(F.format_number(v, 1), F.lit(","), F.lit("")), F.lit("%"))
                unit = F.when(F.contains(s["text"], shown) | F.contains(s["text"], fixed), "percent")
                result = claim(
                    s, "result", "Study", "reports", s["text"],
                    F.when(metric.isNotNull(), CONFIDENCE["result_metric"]).otherwise(CONFIDENCE["result"]),
                    metric=metric, value=v, unit=unit,
                )
                named = claim(s, "metric", "Evaluation", "uses metric", metric, CONFIDENCE["metric"], metric=metric)
                return F.when(metric.isNotNull(), F.array(result, named)).otherwise(F.array(result))

            return F.when(wanted, let(number, lambda v: F.when(v.isNotNull(), emit(v))))

        # Sentences without a number report nothing, so no metric is sought there.
        both = lambda ns: F.struct(choose_metric(s["text"], _of_type(s, "METRIC"), order).alias("metric"), ns.alias("numbers"))
        return let(numbers, lambda ns: F.when(F.size(ns) > 0, let(both(ns), with_numbers)))

    def of(s: Column) -> Column:
        return let(bands(s), lambda b: F.when(F.size(b) > 0, b).otherwise(general(s)))

    lists = F.transform(sentences, of)
    return F.flatten(F.filter(lists, lambda c: c.isNotNull()))


def signal_claims(sentences: Column, kind: str, signals=None) -> Column:
    flagged = F.filter(sentences, lambda s: T.contains_signal(s["text"], signals or L.SIGNALS[kind]))
    return F.transform(
        flagged, lambda s: claim(s, kind, "Document", PREDICATES[kind], s["text"], CONFIDENCE["signal"])
    )


DEFINITION = f"(?i)^(.{{2,80}}?){T.WS}+(?:is|are|refers to|means){T.WS}+(.{{20,260}})$"


def definition_claims(sentences: Column, pattern: str = DEFINITION) -> Column:
    def defines(s: Column) -> Column:
        named = F.exists(s["entities"], lambda e: e["type"].isin("CONCEPT", "METHOD", "ACRONYM"))
        return (F.char_length(s["text"]) <= 360) & named & s["text"].rlike(pattern)

    return F.transform(
        F.filter(sentences, defines),
        lambda s: claim(
            s, "definition", T.strip(F.regexp_extract(s["text"], pattern, 1)), "is defined as",
            F.regexp_extract(s["text"], pattern, 2), CONFIDENCE["definition"],
        ),
    )


def claim_key(c: Column) -> Column:
    return F.concat(c["type"], F.lit(":"), T.squeeze_strip(F.lower(c["object"])))


def union_claims(*lists: Column) -> Column:
    """All extractors in order; the first of equal claims stays; ordinal ids."""
    every = F.concat(*[F.coalesce(x, _no_claims()) for x in lists])
    return F.transform(
        keep_first(every, claim_key),
        lambda c, i: c.withField("claim_no", i + 1).withField(
            "id", F.concat(F.lit("claim-"), c["type"], F.lit("-"), (i + 1).cast("string"))
        ),
    )


def _no_claims() -> Column:
    blank = F.struct(
        F.lit(0).alias("no"), F.lit("").alias("text"), F.lit("").alias("section"), F.lit(0).alias("page")
    )
    return F.filter(F.array(claim(blank, "", "", "", "", 0.0)), lambda c: F.lit(False))


def extract_claims(sentences: Column, vocabulary: dict | None = None) -> Column:
    """Claims of one document from annotated, scored sentences."""
    v = vocabulary or {}
    signals = {**L.SIGNALS, **v.get("signals", {})}
    nouns = v.get("sample_nouns", L.SAMPLE_NOUNS)
    return let(
        sentences,
        lambda ss: union_claims(
            problem_claims(ss, signals["problem"]),
            method_claims(ss, signals["method"]),
            tool_claims(ss),
            data_source_claims(ss, v.get("data_wording", "dataset|data set|corpus|benchmark")),
            sample_claims(ss, nouns),
            result_claims(ss, nouns, v.get("result_words", L.RESULT_WORDS), v.get("metric_order")),
            signal_claims(ss, "contribution", signals["contribution"]),
            signal_claims(ss, "limitation", signals["limitation"]),
            signal_claims(ss, "future_work", signals["future_work"]),
            definition_claims(ss, v.get("definition", DEFINITION)),
        ),
    )


# ---- validation ----------------------------------------------------------------------------------


def contains_number(text: Column, value: Column) -> Column:
    """The number stands in the text, not inside a longer number on its left."""
    quoted = F.replace(plain_number(value), F.lit("."), F.lit("\\."))
    return F.regexp_like(text, F.concat(F.lit("(?:^|[^0-9])"), quoted, F.lit(f"(?:%|{T.EDGE})")))


def metric_supported(metric: Column, evidence: Column) -> Column:
    name, low = F.lower(metric), F.lower(evidence)
    return (
        F.when(name == "accuracy", F.contains(low, F.lit("accuracy")) | F.contains(low, F.lit("accurate")))
        .when(name.isin("inaccuracy", "prediction inaccuracy"), F.contains(low, F.lit("inaccuracy")))
        .otherwise(F.contains(low, name))
    )


def validate_claims(claims: Column) -> Column:
    """Claims with messages, status, duplicate mark and confidence after checks."""

    def check(cs: Column) -> Column:
        firsts = F.transform(keep_first(cs, claim_key), lambda c: c["claim_no"])

        def judge(c: Column, first: Column) -> Column:
            bare = F.coalesce(T.strip(c["evidence"]), F.lit("")) == ""
            messages = F.array_compact(
                F.array(
                    F.when(bare, F.lit("missing_evidence")),
                    F.when(c["value"].isNotNull() & ~contains_number(c["evidence"], c["value"]), F.lit("unsupported_number")),
                    F.when(
                        c["metric"].isNotNull() & (c["metric"] != "") & ~metric_supported(c["metric"], c["evidence"]),
                        F.lit("metric_mismatch"),
                    ),
                )
            )
            return let(
                messages,
                lambda m: c.withField("messages", m)
                .withField("status", F.when(F.size(m) == 0, "valid").otherwise("rejected"))
                .withField("is_duplicate", ~F.array_contains(first, c["claim_no"]))
                .withField("confidence", F.when(F.size(m) == 0, c["confidence"]).otherwise(F.least(c["confidence"], F.lit(0.35)))),
            )

        return let(firsts, lambda f: F.transform(cs, lambda c: judge(c, f)))

    return let(claims, check)


def is_valid(c: Column) -> Column:
    return (c["status"] == "valid") & ~c["is_duplicate"]


def contradictions(valid: Column) -> Column:
    """1 when the valid result claims give more than one accuracy value."""
    values = F.filter(
        valid, lambda c: (c["type"] == "result") & (F.lower(c["metric"]) == "accuracy") & c["value"].isNotNull()
    )
    return F.when(F.size(F.array_distinct(F.transform(values, lambda c: c["value"]))) > 1, 1).otherwise(0)


def field_states(expected: Column, valid: Column) -> Column:
    """array<struct<field, required, state>> for array<struct<field, required, applicable>>."""
    types = F.transform(valid, lambda c: c["type"])
    return let(
        types,
        lambda t: F.transform(
            expected,
            lambda e: F.struct(
                e["field"].alias("field"), e["required"].alias("required"),
                F.when(~e["applicable"], "not_applicable")
                .when(F.array_contains(t, e["field"]), "present")
                .otherwise("missing")
                .alias("state"),
            ),
        ),
    )


def validation_report(claims: Column, states: Column, bad_concepts: Column) -> Column:
    """Ratios, issue counts and verdict of a document's validated claims."""

    def report(cs: Column, valid: Column) -> Column:
        numeric = F.filter(valid, lambda c: c["value"].isNotNull())
        good = F.filter(numeric, lambda c: contains_number(c["evidence"], c["value"]))
        grounded = F.size(F.filter(valid, lambda c: c["evidence"] != ""))
        errors = F.aggregate(cs, F.lit(0), lambda acc, c: acc + F.size(c["messages"]))
        missing = F.size(F.filter(states, lambda s: s["required"] & (s["state"] == "missing")))
        clash = contradictions(valid)
        return F.struct(
            F.size(valid).alias("valid"),
            (F.size(cs) - F.size(valid)).alias("rejected"),
            F.when(F.size(cs) > 0, grounded / F.size(cs)).otherwise(0.0).alias("grounded_ratio"),
            F.when(F.size(numeric) > 0, F.size(good) / F.size(numeric)).otherwise(1.0).alias("numeric_ratio"),
            F.greatest(F.lit(0.0), 1 - clash / F.greatest(F.lit(1), F.size(valid))).alias("consistency"),
            errors.alias("claim_errors"), missing.alias("missing_required"), clash.alias("contradictions"),
            bad_concepts.alias("invalid_concepts"),
            ((F.size(valid) > 0) & (errors + missing == 0)).alias("passed"),
        )

    return let(claims, lambda cs: let(F.filter(cs, is_valid), lambda v: report(cs, v)))


# Key point types in order with label and quota.
KEY_POINTS = [
    ("method", "Method", 1), ("tool", "Tool", 1), ("sample", "Study sample", 1), ("metric", "Evaluation metric", 1),
    ("result", "Reported result", 3), ("contribution", "Contribution", 1),
]


def key_points(valid: Column, n: int = 8) -> Column:
    """array<struct<label, value, claim_id, page>> by type quota."""

    def of(kind: str, label: str, quota: int, cs: Column) -> Column:
        return F.transform(
            F.slice(F.filter(cs, lambda c: c["type"] == kind), 1, quota),
            lambda c: F.struct(
                F.lit(label).alias("label"), c["object"].alias("value"), c["id"].alias("claim_id"), c["page"].alias("page")
            ),
        )

    return let(valid, lambda cs: F.slice(F.concat(*[of(*k, cs) for k in KEY_POINTS]), 1, n))


def headline(valid: Column) -> Column:
    """First valid claim per type as named fields."""

    def fields(cs: Column) -> Column:
        def first(kind: str) -> Column:
            return first_where(cs, lambda c: c["type"] == kind)["object"]

        accuracy = first_where(cs, lambda c: (c["type"] == "result") & (F.lower(c["metric"]) == "accuracy"))["value"]
        metric = first_where(cs, lambda c: (c["type"] == "result") & c["metric"].isNotNull() & (c["metric"] != ""))["metric"]
        return F.struct(
            first("method").alias("method"), first("data_source").alias("dataset"), first("problem").alias("problem"),
            accuracy.alias("accuracy"), metric.alias("metric"), first("limitation").alias("limitations"),
            first("future_work").alias("future_work"),
            F.transform(F.filter(cs, lambda c: c["type"] == "contribution"), lambda c: c["object"]).alias("contributions"),
            key_points(cs).alias("key_points"),
        )

    return let(valid, fields)
