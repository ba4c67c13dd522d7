"""Benchmark decontamination with a distributed positional inverted index.

Training words are counted for the vocabulary of the test items. Each window
of an item (10 words, or a shorter item whole) is then looked up by its two
rarest words: their postings (document, position) are stored, shifted by the
word's place in the window, and intersected. Same start: a candidate, which is
compared word by word with the context stored beside the rarest word's
posting, so an exact match is exact. Starts at most ``slop`` apart: a
proximity match of the two rarest words.

Common words are never posted, so the index holds rare words only, and a
window costs as many rows as its rarest word has places. Item vocabulary and
windows are broadcast after they are counted against the broadcast bound;
beyond it they are joined by shuffle, where adaptive execution splits the
partitions of frequent words.

Defined cases: null text has no words; items without words match nothing; an
item without an id is counted but has no place among the listed ids;
equal windows of several items are one window owned by all of them; a
document is its doc_id and its text, so texts that share an id, or have none,
are judged each by itself and repeated rows give equal rows;
empty tables give rows without hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskset.llm.common import is_small, key_id, lower_az, plain_id, stored, words

# Everything in ASCII but digits and lower-case letters separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
SLOP = 3
CELL = 64
KEY = ["doc_id", "_th"]


def _hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("_th")


def _tokens(df: DataFrame, key: str) -> DataFrame:
    return df.select(key_id(key), _hash(), words(lower_az(F.col("text")), SEPARATORS).alias("_words"))


def windows(items: DataFrame, size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Stored (win, terms) with distinct terms, and (win, item_id), its owners."""
    toks = _tokens(items, "item_id").where(F.size("_words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("_words") - (size - 1), F.lit(1)))
    cut = stored(toks.select("item_id", F.explode(F.transform(
        starts, lambda s: F.slice("_words", s, size))).alias("terms")).distinct(), "cut")
    # Short numbers, as they are shuffled with every posting; fixed once stored.
    wins = stored(cut.select("terms").distinct().withColumn("win", F.monotonically_increasing_id()), "windows")
    return wins.select("win", "terms"), stored(cut.join(wins, "terms").select("win", "item_id"), "owners")


def _hinted(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if is_small(df) else df


def search(docs: DataFrame, items: DataFrame, size: int = WINDOW, slop: int = SLOP) -> tuple[DataFrame, DataFrame]:
    """(doc_id, _th, start, win, n) matches, stored, and the windows' owners.

    ``start`` counts words from 0. Rows with a window are phrases; rows
    without are proximity matches, at the place of the rarest word.
    """
    wins, owners = windows(items, size)
    terms = wins.select("win", F.size("terms").alias("n"), F.posexplode("terms").alias("off", "term"))
    vocabulary = stored(terms.select("term").distinct(), "vocabulary")
    toks = _tokens(docs, "doc_id")
    counts = (toks.select(F.explode("_words").alias("term")).join(_hinted(vocabulary), "term")
              .groupBy("term").agg(F.count(F.lit(1)).alias("freq")))
    # The two rarest places of each window; a window with a word that no
    # document has cannot occur. Windows of one passage mostly share them, so
    # lists are intersected per pair of words and distance, not per window.
    counted = terms.join(stored(counts, "counts"), "term", "left")
    rarest = Window.partitionBy("win").orderBy("freq", "off")
    whole = Window.partitionBy("win")
    ranked = (counted.withColumn("_rank", F.row_number().over(rarest)).withColumn("_seen", F.count("freq").over(whole))
              .where((F.col("_rank") <= 2) & (F.col("_seen") == F.col("n"))))
    at = F.collect_list(F.struct("_rank", "term", "off"))
    places = ranked.groupBy("win", "n").agg(F.sort_array(at).alias("_at")).select(
        "win", "n", F.col("_at")[0]["term"].alias("term"), F.col("_at")[0]["off"].alias("off"),
        F.get("_at", F.lit(1))["term"].alias("term2"),
        (F.get("_at", F.lit(1))["off"] - F.col("_at")[0]["off"]).alias("delta"))
    pairs = places.join(wins, "win").groupBy("term", "term2", "delta").agg(
        F.collect_list(F.struct("win", "n", "off", "terms")).alias("wins"))
    pairs = stored(pairs.withColumn("pair", F.monotonically_increasing_id()), "pairs")
    # The index: places of the rare words, with what stands around each.
    rare = stored(pairs.select("term").union(pairs.select("term2").where("term2 is not null")).distinct(), "rare")
    seen = toks.select(*KEY, "_words", F.posexplode("_words").alias("pos", "term")).join(_hinted(rare), "term")
    low = F.greatest(F.col("pos") - (size - 1), F.lit(0))
    postings = stored(seen.select("term", *KEY, "pos", low.alias("low"),
                                  F.slice("_words", low + 1, 2 * size - 1).alias("around")), "postings")
    # First lists: with the windows that stand here word by word.
    inside = F.filter("wins", lambda w: (F.col("pos") - w["off"] >= F.col("low")) & (F.slice(
        "around", F.greatest(F.col("pos") - w["off"] - F.col("low"), F.lit(0)) + 1, w["n"]) == w["terms"]))
    first = postings.join(_hinted(pairs), "term").select(
        "pair", *KEY, "pos", F.col("term2").isNull().alias("alone"),
        F.transform(inside, lambda w: F.struct(w["win"].alias("win"), (F.col("pos") - w["off"]).alias("start"),
                                               w["n"].alias("n"))).alias("found"))
    first = stored(first, "first")
    second = postings.select("term", *KEY, "pos").join(
        _hinted(pairs.select(F.col("term2").alias("term"), "pair", "delta")), "term").select(
        "pair", *KEY, (F.col("pos") - F.col("delta")).alias("pos2"))
    # Intersect in cells of CELL words; places near an edge are in two.
    cells = F.array_distinct(F.array(*[F.floor((F.col("pos2") + d) / CELL) for d in (-slop, slop)]))
    near = second.withColumn("cell", F.explode(cells))
    met = first.where(~F.col("alone")).withColumn("cell", F.floor(F.col("pos") / CELL)).join(
        near, ["pair", *KEY, "cell"]).where(F.abs(F.col("pos") - F.col("pos2")) <= slop)
    phrase = (F.size("found") > 0) & (F.col("pos") == F.col("pos2"))
    met = met.withColumn("_phrase", phrase).where("_phrase or size(found) = 0")
    both = met.select(*KEY, F.explode(F.when(F.col("_phrase"), F.col("found")).otherwise(F.array(F.struct(
        F.lit(None).cast("long").alias("win"), F.col("pos").alias("start"), F.lit(0).alias("n"))))).alias("_m"))
    alone = first.where("alone").select(*KEY, F.explode("found").alias("_m"))
    return stored(both.unionByName(alone).select(*KEY, "_m.*").distinct(), "matches"), owners


def assess(docs: DataFrame, items: DataFrame, size: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """A row per document: words, hit words, items with their ids, near matches."""
    matches, owners = search(docs, items, size, slop)
    exact = matches.where("win is not null")
    # Hit words: the union of the windows, summed along each document.
    ordered = Window.partitionBy(*KEY).orderBy("start", "end")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    spans = exact.select(*KEY, "start", (F.col("start") + F.col("n")).alias("end")).distinct()
    hits = spans.withColumn("_seen", F.coalesce(F.max("end").over(before), F.lit(0))).groupBy(*KEY).agg(
        F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "_seen"))).alias("n_hit"))
    ids = exact.select(*KEY, "win").distinct().join(owners, "win").groupBy(*KEY).agg(
        F.size(F.collect_set("item_id")).alias("_items"),
        F.sort_array(F.collect_set(plain_id("item_id").cast("string"))).alias("_ids"))
    close = matches.where("win is null").groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_near"))
    found = stored(hits.join(ids, KEY, "left").join(close, KEY, "full"), "found")
    sizes = _tokens(docs, "doc_id").select(*KEY, F.size("_words").cast("long").alias("n_words"))
    out = sizes.join(_hinted(found), KEY, "left")
    ids = F.coalesce("_ids", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(plain_id(), "n_words", n_hit.alias("n_hit"),
                      F.coalesce("_items", F.lit(0)).cast("long").alias("n_items"),
                      F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
                      F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))


def keep_clean(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """The documents without an exact match, all columns as they were."""
    matches, _ = search(docs, items, size)
    hit = stored(matches.where("win is not null").select(*KEY).distinct(), "hit")
    packed = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("_row"), key_id(), _hash())
    return packed.join(_hinted(hit), KEY, "left_anti").select("_row.*")
