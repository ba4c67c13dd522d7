"""Line dedup by pairwise alignment.

Lines with a word are named by 128 bits. A line that several documents hold
points each of them to the first document that holds it, so every overlapping
document is paired with the document its lines come from, and a line held by
thousands of documents makes one pair for each of them, not a pair for every
two. Pairs are aligned with patience diff over their repeated lines: those that
are once in either document and keep their order (a longest increasing
subsequence) anchor the alignment, which goes on between anchors and along
equal neighbours. Aligned blocks are deleted from the later document.

``every_holder`` goes on until each line was aligned with all its earlier
holders or is deleted, so that the result is that of aligning all overlapping
pairs. Documents with one sequence of repeated lines are a class: the later
ones align as a whole with its first, and only firsts are compared. Lines that
are left find further documents through rare lines first: a line of at most
``RARE`` holders asks for all of them at once. Common lines that no such pair
explained then ask for their holders in growing chunks, dealt by the holder's
hash, so a pair is made only while a line of it is left; none is ever skipped.

Texts equal as a whole are one text: the later copies lose all their lines.
Lines that no other document holds cannot align and are left out of the
alignment's input, which keeps it small; their places still separate blocks.

Defined cases: null text has no lines; lines without a word are kept and not
counted; a null doc_id is smaller than all others; rows with the same doc_id
are not later than each other; lines repeated within one document are deleted
only where they align; ``n_partners`` counts the first holders a document is
paired with; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskset.llm.common import BLANKS, is_small, key_id, later_copies, plain_id, stored

KEY = ["doc_id", "_th"]
MIN_BLOCK = 1                # lines in a block that is deleted
RARE = 64                    # holders of a rare line; of a common line, holders asked for at first
WIDER = 8                    # growth of that by round
LINE = ["h", "g"]            # a line's name: 128 bits of two hashes


def increasing(values: list[int]) -> list[int]:
    """Indexes of a longest increasing subsequence, by piles of cards."""
    tops: list[int] = []
    cards: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        at = bisect_left(tops, v)
        back.append(cards[at - 1] if at else -1)
        if at == len(tops):
            tops.append(v)
            cards.append(i)
        else:
            tops[at], cards[at] = v, i
    out = []
    i = cards[-1] if cards else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Patience diff: pairs of places of equal lines, increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        al, ah, bl, bh = todo.pop()
        while al < ah and bl < bh and a[al] == b[bl]:
            out.append((al, bl))
            al, bl = al + 1, bl + 1
        while al < ah and bl < bh and a[ah - 1] == b[bh - 1]:
            ah, bh = ah - 1, bh - 1
            out.append((ah, bh))
        if al == ah or bl == bh:
            continue
        in_a, in_b = Counter(a[al:ah]), Counter(b[bl:bh])
        place = {h: j for j, h in enumerate(b[bl:bh], bl) if in_b[h] == 1}
        once = [(i, place[h]) for i, h in enumerate(a[al:ah], al) if in_a[h] == 1 and h in place]
        anchors = [once[k] for k in increasing([j for _, j in once])]
        if not anchors:
            continue
        out += anchors
        edges = [(al - 1, bl - 1), *anchors, (ah, bh)]
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


def deleted(own: list[tuple], other: list[tuple], least: int = MIN_BLOCK) -> list[int]:
    """Places of the lines of ``own`` in aligned blocks of at least ``least`` lines.

    Both are (place, name) lists; a block is a run of aligned lines that are
    neighbours in both documents.
    """
    pairs = [(own[i][0], other[j][0]) for i, j in align([h for _, h in own], [h for _, h in other])]
    out: list[int] = []
    block: list[int] = []
    before = None
    for p, q in pairs:
        if before is not None and (p, q) != (before[0] + 1, before[1] + 1):
            out += block if len(block) >= least else []
            block = []
        block.append(p)
        before = p, q
    return out + (block if len(block) >= least else [])


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        places = [deleted(*([(x["pos"], (x["h"], x["g"])) for x in side] for side in (own, other)))
                  for own, other in zip(batch.column("own").to_pylist(), batch.column("other").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("_th"), pa.array(places, pa.list_(pa.int32()))],
            names=["doc_id", "_th", "places"])


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _with_word(line: Column) -> Column:
    return F.length(F.translate(line, BLANKS, "")) > 0


def _hinted(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if is_small(df) else df


def _places(found: DataFrame) -> DataFrame:
    return found.groupBy(*KEY).agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))


def _names(own: Column) -> Column:
    return F.transform(own, lambda x: F.struct(x["h"].alias("h"), x["g"].alias("g")))


def _left(docs: DataFrame) -> DataFrame:
    """(doc_id, _th, h, g): the lines of ``docs`` that are not deleted yet."""
    rest = F.filter("own", lambda x: ~F.array_contains("places", x["pos"]))
    return docs.where(F.size("own") > F.size("places")).select(
        *KEY, F.explode(F.array_distinct(_names(rest))).alias("_l")).select(*KEY, "_l.*")


def _compared(docs: DataFrame, pairs: DataFrame, other: DataFrame) -> DataFrame:
    """``docs`` with the places that align in ``pairs`` (doc_id, _th, own, o_doc, o_th) added, stored."""
    met = pairs.join(other, ["o_doc", "o_th"]).select(*KEY, "own", "other")
    found = met.mapInArrow(_aligned, "doc_id long, _th long, places array<int>")
    # Added by one grouping of the documents with what was found.
    rows = docs.select(*KEY, "own", "places").unionByName(found, allowMissingColumns=True)
    return stored(rows.groupBy(*KEY).agg(F.first("own", ignorenulls=True).alias("own"), F.array_distinct(
        F.flatten(F.collect_list("places"))).alias("places")), "docs")


def _all_holders(lists: DataFrame) -> DataFrame:
    """(doc_id, _th, own, firsts) -> (doc_id, _th, places) after all earlier holders of each line.

    With blocks of one line the places between repeated lines do not matter,
    so the first document of each class answers for all of it.
    """
    classes = stored(lists.groupBy("cls").agg(F.min("doc_id").alias("m")), "classes")
    named = lists.join(_hinted(classes), "cls")
    whole = named.where("doc_id > m").select(*KEY, F.transform("own", lambda x: x["pos"]).alias("places"))
    reps = stored(named.where("doc_id = m").select(*KEY, "own", "firsts"), "reps")
    other = _hinted(stored(reps.select(F.col("doc_id").alias("o_doc"), F.col("_th").alias("o_th"), F.col("own").alias("other")),
                           "others"))
    nothing = F.array().cast("array<int>").alias("places")
    first = reps.select(*KEY, "own", F.explode("firsts").alias("_f")).select(
        *KEY, "own", F.col("_f.doc_id").alias("o_doc"), F.col("_f._th").alias("o_th"))
    docs = _compared(reps.select(*KEY, "own", nothing), first, other)

    # Holders of the lines that are left: each has a slot by its hash among as many as there are.
    asked = _hinted(stored(_left(docs).select(*LINE).distinct(), "asked"))
    lines = reps.select(F.col("doc_id").alias("o_doc"), F.col("_th").alias("o_th"),
                        F.explode(F.array_distinct(_names(F.col("own")))).alias("_l")).select("o_doc", "o_th", "_l.*")
    holders = stored(lines.join(asked, LINE), "holders")
    counts = _hinted(stored(holders.groupBy(*LINE).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "counts"))
    spread = F.pmod(F.xxhash64("o_doc", "o_th"), F.col("n"))
    slots = _hinted(stored(holders.join(counts, LINE).select("o_doc", "o_th", *LINE, spread.alias("slot")), "slots"))

    def ask(docs: DataFrame, left: DataFrame, at: int, upto: Column) -> DataFrame:
        wanted = left.withColumn("slot", F.explode(F.sequence(F.lit(at).cast("long"), upto - 1)))
        pairs = wanted.join(slots, [*LINE, "slot"]).where("o_doc < doc_id").select(*KEY, "o_doc", "o_th").distinct()
        return _compared(docs, pairs.join(_hinted(docs.select(*KEY, "own")), KEY), other)

    def waiting(docs: DataFrame) -> DataFrame:
        return _left(docs).join(counts, LINE)

    rare = waiting(docs).where(F.col("n") <= RARE)
    if not rare.isEmpty():
        docs = ask(docs, rare, 0, F.col("n"))
    at, step = 0, RARE
    while not (common := waiting(docs).where((F.col("n") > RARE) & (F.col("n") > at))).isEmpty():
        docs = ask(docs, common, at, F.least("n", F.lit(at + step)))
        at, step = at + step, step * WIDER
    return whole.unionByName(docs.select(*KEY, "places"))


def overlaps(texts: DataFrame, every_holder: bool = False) -> DataFrame:
    """(doc_id, _th, text) -> stored (doc_id, _th, places, partners); no places: the whole text."""
    later = later_copies(texts)
    once = texts.join(_hinted(later), KEY, "left_anti")
    full = F.filter(_lines(F.col("text")), _with_word)
    lines = stored(once.select(*KEY, F.posexplode(F.transform(full, lambda x: F.struct(
        F.xxhash64(x).alias("h"), F.xxhash64(F.lit(1), x).alias("g")))).alias("pos", "_l")).select(*KEY, "pos", "_l.*"), "lines")
    me = F.struct(*KEY)
    # Stored before the join, whose sides are then plain shuffles: adaptive
    # execution can split a line that a third of all documents hold.
    firsts = stored(lines.groupBy(*LINE).agg(F.min(me).alias("first"), F.max(me).alias("last"))
                    .where("first <> last").select(*LINE, "first"), "firsts")
    earlier = F.when(F.col("first.doc_id") < F.col("doc_id"), F.col("first"))
    lists = lines.join(_hinted(firsts), LINE).groupBy(*KEY).agg(
        F.sort_array(F.collect_set(F.struct("pos", *LINE))).alias("own"), F.collect_set(earlier).alias("firsts"))
    sequence = F.concat_ws(" ", F.transform("own", lambda x: F.concat_ws(":", x["h"].cast("string"), x["g"].cast("string"))))
    lists = stored(lists.withColumn("cls", F.md5(sequence)) if every_holder else lists, "lists")
    partners = lists.select(*KEY, F.size("firsts").cast("long").alias("partners")).where("partners > 0")
    if every_holder:
        found = stored(_all_holders(lists), "all").where(F.size("places") > 0)
    else:
        other = lists.select(F.col("doc_id").alias("o_doc"), F.col("_th").alias("o_th"), F.col("own").alias("other"))
        pairs = lists.select(*KEY, "own", F.explode("firsts").alias("_f")).select(
            *KEY, "own", F.col("_f.doc_id").alias("o_doc"), F.col("_f._th").alias("o_th"))
        found = _places(pairs.join(other, ["o_doc", "o_th"]).select(*KEY, "own", "other").mapInArrow(
            _aligned, "doc_id long, _th long, places array<int>"))
    own = partners.join(found, KEY, "left").select(
        *KEY, F.coalesce("places", F.array().cast("array<int>")).alias("places"), "partners")
    whole = later.select(*KEY, F.lit(None).cast("array<int>").alias("places"), F.lit(1).cast("long").alias("partners"))
    return stored(own.unionByName(whole), "overlaps")


def dedup(docs: DataFrame, every_holder: bool = False) -> DataFrame:
    """doc_id, n_lines, n_removed, n_partners, kept: the text without its deleted lines.

    Aligned with the first holders of its lines, or with ``every_holder``.
    """
    texts = docs.select(key_id(), F.col("text").cast("string"),
                        F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("_th"))
    found = overlaps(texts, every_holder).withColumn("_hit", F.lit(True))
    rows = texts.join(_hinted(found), KEY, "left").withColumn("_lines", _lines(F.col("text")))
    # Place of each line among those with a word: what was deleted goes.
    n = F.size(F.filter("_lines", _with_word)).cast("long")
    whole = F.coalesce("_hit", F.lit(False)) & F.col("places").isNull()
    gone = F.when(whole, n).otherwise(F.coalesce(F.size("places").cast("long"), F.lit(0)))
    rows = rows.select("doc_id", "text", "places", whole.alias("whole"), n.alias("n_lines"), gone.alias("n_removed"),
                       F.coalesce("partners", F.lit(0)).cast("long").alias("n_partners"))
    out = rows.mapInArrow(_kept, "doc_id long, n_lines long, n_removed long, n_partners long, kept string")
    return out.select(plain_id(), "n_lines", "n_removed", "n_partners", "kept")


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = []
        for text, places, whole in zip(*(batch.column(c).to_pylist() for c in ("text", "places", "whole")), strict=True):
            drop, at, own = set(places or ()), 0, []
            if not drop and not whole:
                kept.append(text or "")
                continue
            for line in (text or "").split("\n"):
                if line.strip(BLANKS):
                    if not whole and at not in drop:
                        own.append(line)
                    at += 1
                else:
                    own.append(line)
            kept.append("\n".join(own))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc_id", "n_lines", "n_removed", "n_partners")), pa.array(kept, pa.string())],
            names=["doc_id", "n_lines", "n_removed", "n_partners", "kept"])
