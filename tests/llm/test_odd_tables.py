"""Empty tables, clashing column names, nulls, repeated rows and long texts, for operators that return whole rows and for every stage."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import decontamination, linededup, ngramjoin, packing, pseudonyms, quality, repair, sharding
from lectern.llm.queries import tokenizer_path
from tests.llm import brute

SF = "/root/testdata/sf0.001"
#: Names that helper columns would have.
NAMES = ("row", "row_", "Bucket", "offset", "KEY", "tie", "lines", "head", "hits", "pack_order", "pack_group", "dropped_id", "__lines", "_row", "unit", "place", "first", "own_id", "length", "n_shingles_")
WORDS = "the quick brown fox jumps over one lazy dog near a river bank today"
ROWS = [(1, WORDS), (2, WORDS), (2, "unlike anything else that stands in this table of texts"), (None, WORDS), (None, WORDS), (7, "zebra " + WORDS[4:] + " again"), (7, "zebra " + WORDS[4:] + " again"), (8, None), (9, ""), (9, ""), (10, f"{WORDS}\nshort\n{WORDS}"), (11, "é " * 200_000)]


@pytest.fixture
def clashing(spark):
    """Rows with a column for every helper name, each with a value to be kept."""

    def make(rows):
        df = spark.createDataFrame([(i, t, "en", "s", len(t or ""), n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, serial long")
        return df.select("*", *[F.lit(77).alias(n) for n in NAMES]).repartition(3)

    return make


def untouched(df):
    return all(r[n] == 77 for r in df.collect() for n in NAMES)


def test_keep_one_goes_by_rows(clashing):
    kept = ngramjoin.keep_one(clashing(ROWS))
    left = Counter((r["doc_id"], (r["text"] or "")[:12]) for r in kept.collect())
    # All copies of WORDS are one component whose first row stays; of rows that repeat id and text one stays.
    assert left == Counter([(1, "the quick br"), (2, "unlike anyth"), (7, "zebra quick "), (8, ""), (9, ""), (9, ""), (10, "the quick br"), (11, "é é é é é é ")])
    assert untouched(kept)


def test_keep_one_on_documents_as_they_come(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = {i for i, _, head in brute.components(rows) if i == head}
    kept = [r["doc_id"] for r in ngramjoin.keep_one(docs).collect()]
    assert sorted(kept) == sorted(want) and len(kept) < len(rows)


def test_clashing_names_survive(clashing, spark):
    bench = spark.createDataFrame([(k, f"item {k} " + " ".join(f"w{k}x{j}" for j in range(12))) for k in range(30)], "item_id long, text string")
    docs = clashing([*ROWS, (20, "item 3 " + " ".join(f"w3x{j}" for j in range(12)) + " and more words behind it " * 3)])
    assert untouched(linededup.dedup_lines(docs)) and untouched(sharding.write_shards(docs, 4, bucket_bytes=1000))
    for words in (10, 10**6):
        cleaned = decontamination.clean(docs, bench, block_words=words)
        assert untouched(cleaned) and not cleaned.where("text like '%w3x5%'").count()
    assert untouched(pseudonyms.pseudonymise_documents(docs, b"key"))
    assert untouched(quality.keep_good(docs, spark.read.parquet(f"{SF}/labels.parquet")))
    pieces = packing.token_pieces(docs, tokenizer_path("byte_bpe_50k.json")).select("*", *[F.lit(77).alias(n) for n in NAMES if n not in ("length", "offset")])
    packed = packing.pack(pieces)
    assert packed.count() == pieces.count() and all(r[n] == 77 for r in packed.collect() for n in NAMES if n not in ("length", "offset"))


def test_removed_lines_are_cut_wherever_they_stand(clashing):
    line = lambda k: f"line number {k} has a few words of its own {k * k}"
    texts = ["\n".join(map(line, range(6))), "\n".join([line(9), line(0), line(5), line(8)]), "\n".join([line(3), "x", line(3)]), f"{line(1)}\n", f"\n{line(2)}", line(4)]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(clashing(rows)).collect()}
    assert got == brute.without_lines(rows)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_odd_and_empty_tables(clashing, spark, name, stage):
    docs = clashing(ROWS)
    out = stage(spark, docs, SF)
    rows = out.collect()
    if name != "best_fit_packing":
        assert out.columns == docs.columns and untouched(out)
        assert len(rows) <= len(ROWS) and {r["serial"] for r in rows} <= set(range(len(ROWS)))
    else:
        assert {r["doc_id"] for r in rows} == {i for i, _ in ROWS}
    empty = stage(spark, docs.limit(0), SF)
    assert empty.count() == 0 and empty.columns == out.columns


def test_stages_as_a_chain(clashing, spark):
    docs = clashing(ROWS)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    ids = Counter(r["doc_id"] for r in docs.collect())
    assert max(ids.values(), default=0) <= 2 and sum(ids[i] for i in (None, 1)) <= 1


def test_equal_rows_spread_over_groups_and_buckets(spark):
    rows = spark.createDataFrame([(None, "same text in every row")] * 3000, "doc_id long, text string")
    pieces = packing.token_pieces(rows, tokenizer_path("byte_bpe_50k.json"))
    packed = packing.pack(pieces, 64, group_pieces=300)
    assert packed.select((F.col("sequence_id") / 2**40).cast("int").alias("g")).distinct().count() == 10
    out = sharding.write_shards(rows, 8, bucket_bytes=4000)
    assert sorted(r["count"] for r in out.groupBy("shard").count().collect()) == [375] * 8


def test_shuffled_order_by_plain_python(spark):
    rows = [(k, "x" * (k % 7)) for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    out = sorted((r["shard"], r["slot"], r["doc_id"]) for r in sharding.write_shards(df, 3, bucket_bytes=10**9).collect())
    places = sharding.fisher_yates(200, sharding.SEED)
    assert [d for *_, d in out] == [rows[k][0] for k in places]
    random = np.random.default_rng(sharding.SEED)
    plain = list(range(200))
    random.shuffle(plain)
    assert sorted(plain) == list(range(200)) and [s for s, *_ in out] == [0] * 67 + [1] * 67 + [2] * 66


def packed_plainly(lengths, size, limit):
    """Best fit over a plain list of open bins (number, free, age)."""
    bins, out, made, clock = [], [], 0, 0
    for n in lengths:
        clock += 1
        fitting = [b for b in bins if b[1] >= n]
        if fitting:
            b = min(fitting, key=lambda b: (b[1], -b[2]))
            bins.remove(b)
        else:
            b = (made, size, clock)
            made += 1
        out.append((b[0], size - b[1]))
        if b[1] > n:
            bins.append((b[0], b[1] - n, clock))
        if len(bins) > limit:
            bins.remove(min(bins, key=lambda b: (b[1], -b[2])))
    return out


@pytest.mark.parametrize("limit", [1, 4, 100])
def test_best_fit_by_a_plain_list(limit):
    lengths = np.random.default_rng(limit).integers(1, 33, 800).tolist()
    bins = packing.BestFit(32, limit)
    assert [bins.put(n) for n in lengths] == packed_plainly(lengths, 32, limit)


def test_the_production_limit_binds_and_wastes_little():
    lengths = np.random.default_rng(5).integers(1, 1025, packing.GROUP_PIECES).tolist()
    bins, closed = packing.BestFit(packing.LENGTH, packing.OPEN_BINS), 0
    close, bins._close_fullest = bins._close_fullest, lambda: None
    for n in lengths:
        bins.put(n)
        if bins.count > bins.open_bins:
            closed += 1
            close()
    assert closed > 100 and bins.made <= 1.01 * -(-sum(lengths) // packing.LENGTH)


@pytest.mark.parametrize("kind", ["passage", "same", "zipf", "random", "documents"])
def test_grammars_go_to_the_end(kind):
    rng = np.random.default_rng(1)
    tokens = {"passage": np.tile(rng.integers(0, 40_000, 64), 2000), "same": np.zeros(50_000, np.int64), "zipf": rng.zipf(1.3, 60_000) % 5000, "random": rng.integers(0, 40_000, 5000), "documents": np.tile(rng.integers(0, 99, 50), 300)}[kind]
    cuts = {"documents": np.arange(0, len(tokens) + 1, 50)}.get(kind, np.array([0, 0, 7, len(tokens) // 2, len(tokens)]))
    symbols, firsts, left, right, length = repair.compress(tokens, cuts)
    assert (repair.expand_all(symbols.astype(np.int64), left, right, length) == tokens).all()
    assert (repair.expand(symbols.astype(np.int64), left, right) == tokens).all()
    pairs = Counter()
    for a, b in zip(firsts, firsts[1:], strict=False):
        pairs.update(zip(symbols[a:b], symbols[a + 1 : b], strict=False))
    assert max(pairs.values(), default=0) < repair.LEAST_COUNT
    if kind in ("passage", "same"):
        assert len(symbols) < len(tokens) / 40 and length.max() > 64
    for k in range(len(cuts) - 1):
        assert (repair.expand(symbols[firsts[k] : firsts[k + 1]].astype(np.int64), left, right) == tokens[cuts[k] : cuts[k + 1]]).all()


@pytest.mark.parametrize("text,values", [
    ("on 25/12/2024 we", ["25/12/2024"]), ("12/25/2024", ["12/25/2024"]), ("32/13/2020", []), ("30/02/2020", []), ("31.12.1999", ["31.12.1999"]),
    ("ring +49 30 901820 now", ["+49 30 901820"]), ("+33 1 42 68 53 00", ["+33 1 42 68 53 00"]), ("+49 1", []), ("2+49 30 901820", []), ("a" * 300 + "@example.com", ["a" * 300 + "@example.com"]),
    ("b9" * 4000 + "@x.org", ["b9" * 4000 + "@x.org"]),
])
def test_more_values_find_pseudonyms(text, values):
    new, spans = pseudonyms.pseudonymise(text, b"key")
    assert [text[a:b] for _, a, b in spans] == values and len(new) == len(text) and (not values or new != text)
    assert pseudonyms.pseudonymise(new, b"key", inverse=True, known=spans)[0] == text


def feistel_plainly(network, value, inverse=False):
    """One walk of the network from its round function alone, as pairs of halves."""
    while True:
        left, right = divmod(value, 1 << network.half)
        for k in reversed(range(network.rounds)) if inverse else range(network.rounds):
            left, right = (right ^ network._round(k, left), left) if inverse else (right, left ^ network._round(k, right))
        value = left * (1 << network.half) + right
        if value < network.n:
            return value


@pytest.mark.parametrize("n", [2, 9, 1000, 10**9, 26**200])
def test_feistel_by_its_rounds(n):
    network = pseudonyms.Feistel(b"key", "tweak", n)
    for value in {0, 1, n // 3, n - 1}:
        made = network.apply(value)
        assert 0 <= made < n and made == feistel_plainly(network, value) and network.apply(made, inverse=True) == value
