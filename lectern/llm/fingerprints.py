"""I-Match fingerprints: hashes of a text's mid-frequency terms under randomised lexicons.

Terms are lower-cased runs of non-blank characters. The lexicon keeps terms whose share of
documents lies in a band; every one of the randomised lexicons of ``SUBSETS`` keeps a random part of
it. A text's distinct terms in such a part, sorted, hash to one place of its fingerprint. Parts
range from the whole lexicon to less than one of its terms, and a place is filled where a text has
1 to ``PLACE_TERMS`` terms, so short texts and very long ones all have places that a partial edit
leaves alone. A text that fills no place has the hash of all its terms of the lexicon in the first
one or, if it has none there, the hash of all its terms.

Beside the places stands I-Match proper: one hash of all terms of the text in the lexicon. The number
of levels follows from the lexicon alone, so fingerprints made with one written lexicon can be compared
whichever tables they come from.

At most (mean distinct terms of a text) / ``LEAST_SHARE`` terms can occur in that share of the texts,
however many texts there are. A lexicon of up to ``BROADCAST_TERMS`` is broadcast, a larger one is joined.

Defined results: a null text is an empty text; texts without terms have an empty fingerprint and
are alike to each other only; texts of at most ``SHORT_TERMS`` terms use all their terms; a very long
text has one array of its terms, and places in the finer levels; rows
that repeat an id follow in the order of a hash of their text; an empty table gives no rows;
further columns of the table are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lectern.llm.shared import id_and_text, staged

LEAST_SHARE, MOST_SHARE = 0.001, 0.2
SHORT_TERMS = 32
#: (parts that the lexicon is cut into, parts used); ``subsets`` goes on from the last one.
SUBSETS = ((1, 1), (4, 4), (16, 12), (64, 12), (256, 12), (1024, 12))
#: Terms of a text in one part, beyond which nearly any edit would change its hash.
PLACE_TERMS = 3
BROADCAST_TERMS = 1 << 22


def terms(text: Column) -> Column:
    """Distinct lower-cased terms of a text, as an array."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), r"[\x20\x09-\x0D]+")), "")


def lexicon(texts: DataFrame, least: float = LEAST_SHARE, most: float = MOST_SHARE) -> DataFrame:
    """Hashes of the terms that occur in a share of the texts within the band."""
    n = texts.count()
    counted = texts.select(F.explode(terms(F.col("text"))).alias("term")).groupBy(F.xxhash64("term").alias("term")).count()
    return counted.where((F.col("count") >= least * n) & (F.col("count") <= most * n)).select("term")


def subsets(terms: int) -> list[tuple[int, int]]:
    """``SUBSETS`` and ever finer ones, until a text with all terms of the lexicon has about one in a part."""
    out = list(SUBSETS)
    while out[-1][0] < terms:
        out.append((4 * out[-1][0], out[-1][1]))
    return out


def _part(parts: int, term: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(parts), term), F.lit(parts))


def _in_part(parts: int, part: int):
    return lambda term: _part(parts, term) == part


def _level(kept: Column, parts: int, used: int) -> Column:
    """The terms in the used parts of one level."""
    return kept if parts == used else F.filter(kept, lambda term: _part(parts, term) < used)


def _places(level: Column, parts: int, used: int) -> list[Column]:
    """One 32-bit hash per randomised lexicon of sorted term hashes; null where no term or too many are in it."""
    own = [level if parts == 1 else F.filter(level, _in_part(parts, part)) for part in range(used)]
    return [F.when(F.size(terms).between(1, PLACE_TERMS), F.hash(terms)) for terms in own]


def with_fingerprints(grouped: DataFrame, sides: dict[str, tuple[str, str]], levels: list[tuple[int, int]]) -> DataFrame:
    """Fingerprints by name, each from a sorted array of term hashes and the hash of all terms of the text.

    The terms of a level are picked once, in a step of their own, and then dealt to its parts.
    """
    others = [c for c in grouped.columns if c not in {c for pair in sides.values() for c in pair}]
    picked = [_level(F.col(kept), *level).alias(f"{name}_{level[0]}") for name, (kept, _) in sides.items() for level in levels]
    rows = grouped.select(*grouped.columns, *picked)
    made = []
    for name in sides:
        places = [_places(F.col(f"{name}_{level[0]}"), *level) for level in levels]
        made.append(F.array(*[p for level in places for p in level]).alias(name))
    rows = rows.select(*others, *[c for pair in sides.values() for c in pair], *made)
    whole = [
        F.when(F.exists(name, lambda p: p.isNotNull()), F.col(name))
        .otherwise(F.concat(F.array(F.when(F.size(kept) > 0, F.hash(kept)).otherwise(F.col(all_terms))), F.slice(F.col(name), 2, sum(used for _, used in levels) - 1)))
        .alias(name)
        for name, (kept, all_terms) in sides.items()
    ]
    return rows.select(*others, *whole)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal places among those that either fingerprint fills; 1 if both are empty, as only texts without terms have them."""
    filled = F.size(F.filter(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x: x["a"].isNotNull() | x["b"].isNotNull()))
    equal = F.size(F.filter(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x: x["a"] == x["b"]))
    return F.when(filled == 0, 1.0).otherwise(equal / filled)


def as_text(places: Column) -> Column:
    return F.array_join(F.transform(places, lambda p: F.coalesce(F.hex(p), F.lit("-"))), ".")


def with_next(texts: DataFrame) -> DataFrame:
    """Each text with its successor by ascending id (the last one's is the first).

    Ids are cut into stretches at approximate quantiles. Each stretch gets a copy of the first
    row of the next one, so a window inside a stretch sees every successor.
    """
    spark = texts.sparkSession
    texts = texts.withColumn("tie", F.xxhash64("text"))
    wanted = max(64, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = sorted({int(b) for b in texts.approxQuantile("doc_id", [k / wanted for k in range(1, wanted)], 0.2 / wanted)})
    known = F.array(*[F.lit(b) for b in bounds]).cast("array<long>")
    stretch = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.size(F.filter(known, lambda b: b < F.col("doc_id"))))
    texts = texts.withColumn("stretch", stretch)
    # One id per stretch passes the driver.
    firsts = sorted((r["stretch"], r["doc_id"]) for r in texts.groupBy("stretch").agg(F.min("doc_id").alias("doc_id")).collect())
    after = [(number, firsts[k - 1][0]) for k, (number, _) in enumerate(firsts)]
    ids = spark.createDataFrame([(n, i) for n, i in firsts], "first_stretch int, first_id long")
    moved = spark.createDataFrame(after, "first_stretch int, before int")
    first = texts.join(F.broadcast(ids.join(moved, "first_stretch")), (F.col("stretch") == F.col("first_stretch")) & F.col("doc_id").eqNullSafe(F.col("first_id")))
    first = first.groupBy("first_stretch").agg(F.min_by(F.struct("doc_id", "text", "tie", "before"), "tie").alias("row")).select("row.*")
    copies = first.select("doc_id", "text", "tie", F.col("before").alias("stretch"), F.lit(1).alias("copy"))
    order = Window.partitionBy("stretch").orderBy("copy", "doc_id", "tie")
    rows = texts.withColumn("copy", F.lit(0)).unionByName(copies)
    ahead = {c: F.lead(c).over(order).alias(f"next_{c}") for c in ("doc_id", "tie", "text")}
    return rows.select("doc_id", "text", "tie", "copy", F.row_number().over(order).alias("nth"), *ahead.values()).where(F.col("copy") == 0).drop("copy")


def edited(n_chars: Column) -> Column:
    """The text with its last quarter replaced by the beginning of the next one."""
    quarter = F.floor(n_chars / 4).cast("int")
    return F.concat(F.substring(F.col("text"), F.lit(1), (n_chars - quarter).cast("int")), F.substring(F.col("next_text"), F.lit(1), quarter))


def fingerprints(docs: DataFrame, least: float = LEAST_SHARE, most: float = MOST_SHARE, id_col: str = "doc_id", text_col: str = "text", known: DataFrame | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited form, by the lexicon ``known`` (as ``lexicon`` makes it) or that of the texts themselves.

    Columns: doc_id, tie (hash of the text), nth (number of the row in its stretch), next_doc_id, next_tie, n_chars, edited_sha256,
    lexicon_hash and edited_lexicon_hash (null without such terms), places and edited_places (arrays of hashes).
    """
    texts = id_and_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    known = known if known is not None else staged(lexicon(texts, least, most), "lexicon")
    n_known = known.count()
    levels = subsets(n_known)
    rows = with_next(texts).withColumn("n_chars", F.length("text").cast("long")).withColumn("edited", edited(F.col("n_chars")))
    keys = ["doc_id", "tie", "nth", "next_doc_id", "next_tie", "n_chars", "edited_sha256"]
    # Bytes while it travels.
    rows = rows.withColumn("edited_sha256", F.unhex(F.sha2("edited", 256)))
    rows = rows.select(*keys, terms(F.col("text")).alias("own"), terms(F.col("edited")).alias("other"))
    whole = {f"{side}_terms": F.when(F.size(side) > 0, F.hash(F.sort_array(side))) for side in ("own", "other")}
    rows = rows.select("*", *[hashed.alias(name) for name, hashed in whole.items()])
    keys += whole
    # Most terms are in both texts and travel once. Sides: 1 the text, 2 the edited text, 3 both.
    sides = F.array(
        F.struct(F.lit(1).alias("side"), F.array_except("own", "other").alias("terms")),
        F.struct(F.lit(2).alias("side"), F.array_except("other", "own").alias("terms")),
        # The null term keeps a row for texts without any term of the lexicon.
        F.struct(F.lit(3).alias("side"), F.concat(F.array_intersect("own", "other"), F.array(F.lit(None).cast("string"))).alias("terms")),
    )
    short = F.when(F.size("own") <= SHORT_TERMS, 1).otherwise(0) + F.when(F.size("other") <= SHORT_TERMS, 2).otherwise(0)
    sides = rows.select(*keys, short.alias("short"), F.explode(sides).alias("x")).select(*keys, "short", "x.side", F.explode("x.terms").alias("word"))
    words = sides.select(*keys, "side", "short", F.when(F.col("word").isNotNull(), F.xxhash64("word")).alias("term"))
    marked = known.withColumn("known", F.lit(3))
    found = words.join(F.broadcast(marked) if n_known <= BROADCAST_TERMS else marked, "term", "left")
    used = F.col("side").bitwiseAND(F.coalesce("known", "short"))
    kept = found.withColumn("used", used).where((F.col("used") > 0) | F.col("term").isNull())
    # Terms are grouped as 32-bit hashes, half the size of those that met the lexicon.
    of = [F.collect_list(F.when((F.col("used") == side) & F.col("term").isNotNull(), F.hash("term"))).alias(f"of{side}") for side in (1, 2, 3)]
    grouped = kept.groupBy(*keys).agg(*of).select(*keys, F.sort_array(F.concat("of1", "of3")).alias("own"), F.sort_array(F.concat("of2", "of3")).alias("other"))
    for name, side in (("lexicon_hash", "own"), ("edited_lexicon_hash", "other")):
        grouped = grouped.withColumn(name, F.when(F.size(side) > 0, F.lower(F.hex(F.xxhash64(side)))))
    made = with_fingerprints(grouped, {"places": ("own", "own_terms"), "edited_places": ("other", "other_terms")}, levels)
    return made.withColumn("edited_sha256", F.lower(F.hex("edited_sha256")))


def compare(table: DataFrame) -> DataFrame:
    """Fingerprints as text, and their likeness to the edited text's and to the next document's."""
    following = table.select(F.col("doc_id").alias("next_doc_id"), F.col("tie").alias("next_tie"), F.col("places").alias("next_places"))
    following = following.dropDuplicates(["next_doc_id", "next_tie"])
    same = table["next_doc_id"].eqNullSafe(following["next_doc_id"]) & (table["next_tie"] == following["next_tie"])
    return table.join(following, same).select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("places")).alias("fingerprint"), as_text(F.col("edited_places")).alias("edited_fingerprint"),
        likeness(F.col("places"), F.col("edited_places")).alias("near_edited"), likeness(F.col("places"), F.col("next_places")).alias("near_next"),
        "lexicon_hash", "edited_lexicon_hash",
    )


def match_documents(docs: DataFrame, least: float = LEAST_SHARE, most: float = MOST_SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return compare(staged(fingerprints(docs, least, most, id_col, text_col), "fingerprints"))
