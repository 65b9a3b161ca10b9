"""Semantic chunking of documents that do not fit one row.

A document arrives as any number of parts in order; its text is their concatenation, cut
anywhere. The result is that of :func:`lexiloom.operators.chunking.semantic_chunks` on the
whole text, but no row, group or task ever holds a document:

* what a part needs from the parts before it (does a sentence begin here?) is a carry of one
  letter and one flag, from ordered operators that stay spread out on a hot document;
* sentences are gathered in blocks of consecutive ones with the neighbours that distances at
  a block's ends need;
* the threshold of a document is selected: a histogram of its distances names the bins that
  hold the two wanted ranks, only the distances in them are ranked;
* breaks are numbered inside blocks and from block to block by running counts; only chunks
  that touch a block's end are put together by a shuffle.

A sentence and a chunk have to fit one row. Parts with the same document and number are taken
in the order of their hashes; null and empty parts add nothing, rows without a document are
left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexiloom.dimensions import BREAKPOINT_PERCENTILE, NEIGHBOUR_BUFFER
from lexiloom.functions.text import fragments
from lexiloom.functions.vectors import encode, neighbour_distances
from lexiloom.operators.chunking import chunk_rows, with_segments
from lexiloom.operators.ordering import MAX_GROUP_ROWS, largest_group, latest_values, previous_values, running_sum
from lexiloom.session import cut_lineage

#: Sentences of a block: bounds the arrays of one row.
BLOCK = 4_096
#: Bins of a document's histogram of distances; bounds its rows, not the result.
BINS = 4_096

_ORDER = ["at", "tie"]


def _pieces(parts: DataFrame, doc: str, part: str, text: str, max_group: int) -> tuple[DataFrame, int]:
    """``url, at, tie, pieces, joins``: fragments of every part; ``joins``: the first one continues a sentence.

    With them the most parts of a document, counted once for all the ordered steps. ``end`` says how a part with other than white space ends: at a terminator (T), in white
    space after one (B), at the boundary character itself (X), or else (N).
    """
    rows = parts.select(F.col(doc).alias("url"), F.col(part).alias("at"), F.col(text).alias("body")).where(
        F.col("url").isNotNull() & (F.col("body") != "")
    )
    most = largest_group(rows, ["url"])
    rows = rows.withColumn("tie", F.xxhash64("body")).withColumn("white", F.col("body").rlike(r"\A\s+\z"))
    body = F.col("body")
    rows = rows.withColumn(
        "end",
        F.when(F.col("white"), None).when(body.endswith("\x01"), "X").when(body.rlike(r"[.!?]\z"), "T")
        .when(body.rlike(r"[.!?]\s+\z"), "B").otherwise("N"),
    )
    rows = previous_values(rows, ["url"], _ORDER, "white", "after_white", max_group, most)
    rows = latest_values(rows, ["url"], _ORDER, "end", "before", max_group, most)
    before, after_white = F.coalesce("before", F.lit("N")), F.coalesce("after_white", F.lit(False))
    spaced = F.col("white") | after_white | body.rlike(r"\A\s")
    stop = (before == "B") | ((before == "T") & spaced)
    fresh = F.col("after_white").isNull() | stop | ((before == "X") & ~after_white)
    cut = fragments(F.when(stop, F.regexp_replace(body, r"\A\s+", "")).otherwise(body))
    marked = F.transform(cut, lambda s, i: F.struct((fresh | (i > 0)).alias("fresh"), s.alias("s")))
    kept = rows.select("url", "at", "tie", F.filter(marked, lambda p: p.s != "").alias("kept")).where(F.size("kept") > 0)
    return kept.select(
        "url", "at", "tie", F.transform("kept", lambda p: p.s).alias("pieces"), (~F.col("kept")[0].fresh).alias("joins")
    ), most


def section_sentences(
    parts: DataFrame, doc: str = "url", part: str = "part", text: str = "text", max_group: int = MAX_GROUP_ROWS
) -> DataFrame:
    """``url, pos, sentence`` of documents given in parts; ``pos`` counts from 1.

    Where no document is hot, the texts move once: all that follows keeps to the documents' partitions.
    """
    rows, most = _pieces(parts, doc, part, text, max_group)
    rows = rows.withColumn("begun", F.size("pieces") - F.col("joins").cast("int"))
    rows = running_sum(rows, ["url"], _ORDER, "begun", "earlier", inclusive=False, max_group=max_group, largest=most)
    # Every piece but a joined first one begins a sentence.
    first = F.col("earlier") + 1 - F.col("joins").cast("int")
    each = rows.select("url", *_ORDER, first.cast("long").alias("first"), F.posexplode("pieces").alias("i", "sentence"))
    # A sentence that reaches over a part's end has a piece in every part it touches.
    pieces = F.sort_array(F.collect_list(F.struct(*_ORDER, "first", "sentence")))
    return each.groupBy("url", (F.col("first") + F.col("i")).alias("pos")).agg(pieces.alias("p")).select(
        "url", "pos", F.array_join(F.transform("p", lambda p: p.sentence), "").alias("sentence")
    )


def section_blocks(sentences: DataFrame, buffer: int = NEIGHBOUR_BUFFER, block: int = BLOCK) -> DataFrame:
    """``url, block, sents, codes, dists``: consecutive sentences and the distances to the next one of each.

    Sentences next to a block's end are handed to the next block as well, by their codes alone.
    """
    if block <= buffer + 1:
        raise ValueError("a block holds more sentences than a neighbourhood reaches")
    own, place = F.floor((F.col("pos") - 1) / block), (F.col("pos") - 1) % block
    targets = F.array(own, F.when(place >= block - buffer, own + 1), F.when((place <= buffer) & (own > 0), own - 1))
    coded = sentences.select("url", "pos", "sentence", encode(F.col("sentence")).alias("code"))
    dealt = coded.select("url", "pos", "sentence", "code", F.explode(F.filter(targets, lambda t: t.isNotNull())).alias("block"))
    home = F.col("block") == own
    item = F.struct("pos", F.when(home, F.col("sentence")).alias("s"), F.col("code").alias("c"))
    rows = dealt.groupBy("url", "block").agg(F.sort_array(F.collect_list(item)).alias("items"), F.count(F.when(home, 1)).alias("own"))
    rows = rows.where(F.col("own") > 0).withColumn("all_codes", F.transform("items", lambda x: x.c))
    rows = rows.withColumn("all_dists", neighbour_distances(buffer)(F.col("all_codes")))
    ahead = F.size(F.filter("items", lambda x: x.pos <= F.col("block") * block))
    size = F.col("own").cast("int")
    return rows.select(
        "url", "block", F.transform(F.slice("items", ahead + 1, size), lambda x: x.s).alias("sents"),
        F.slice("all_codes", ahead + 1, size).alias("codes"), F.slice("all_dists", ahead + 1, size).alias("dists"),
    )


def section_thresholds(
    blocks: DataFrame, percentile: float = BREAKPOINT_PERCENTILE, bins: int = BINS, max_group: int = MAX_GROUP_ROWS
) -> DataFrame:
    """``url, threshold``: exact percentile of a document's distances, linearly interpolated.

    A document of one sentence has no row.
    """

    def bin_of(distance: Column) -> Column:
        return F.floor(distance * bins)

    counts = (
        blocks.select("url", F.explode(F.transform("dists", bin_of)).alias("bin")).groupBy("url", "bin").count()
    )
    per_doc = Window.partitionBy("url")
    position = (F.col("n") - 1) * (percentile / 100.0)
    ranked = counts.select(
        "url", "bin", F.sum("count").over(per_doc.orderBy("bin")).alias("upto"), "count", F.sum("count").over(per_doc).alias("n"),
    ).withColumn("low", F.floor(position)).withColumn("high", F.ceil(position))
    before = F.col("upto") - F.col("count")
    holds = ((before <= F.col("low")) & (F.col("low") < F.col("upto"))) | ((before <= F.col("high")) & (F.col("high") < F.col("upto")))
    # The bins between these two are empty: their ranks are next to each other.
    wanted = ranked.where(holds).groupBy("url", "n", "low", "high").agg(
        F.min("bin").alias("from_bin"), F.max("bin").alias("to_bin"), F.min(before).alias("below")
    )
    near = F.filter("dists", lambda d: (bin_of(d) >= F.col("from_bin")) & (bin_of(d) <= F.col("to_bin")))
    values = blocks.select("url", "dists").join(wanted, "url").select("url", "n", "low", "high", "below", F.explode(near).alias("d"))
    values = cut_lineage(values.groupBy("url", "n", "low", "high", "below", "d").count())
    placed = running_sum(values, ["url"], ["d"], "count", "upto", max_group=max_group)
    upto = F.col("below") + F.col("upto")
    found = placed.groupBy("url", "n", "low", "high").agg(
        F.min(F.when(upto > F.col("low"), F.col("d"))).alias("at_low"), F.min(F.when(upto > F.col("high"), F.col("d"))).alias("at_high"),
    )
    value = F.col("at_low") + (F.col("at_high") - F.col("at_low")) * (position - F.col("low"))
    return found.select("url", value.alias("threshold"))


def section_chunks(
    parts: DataFrame,
    doc: str = "url",
    part: str = "part",
    text: str = "text",
    buffer: int = NEIGHBOUR_BUFFER,
    percentile: float = BREAKPOINT_PERCENTILE,
    block: int = BLOCK,
    max_group: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Chunk rows of documents given in parts, as ``semantic_chunks`` gives them for whole texts.

    A ``metadata`` map is taken from the first part of a document.
    """
    blocks = cut_lineage(section_blocks(section_sentences(parts, doc, part, text, max_group), buffer, block))
    thresholds = section_thresholds(blocks, percentile, max_group=max_group)
    narrow = blocks.select("url", "block", "dists").join(thresholds, "url", "left").select(
        "url", "block", "threshold", F.size(F.filter("dists", lambda d: d > F.col("threshold"))).alias("breaks")
    )
    numbered = running_sum(narrow, ["url"], ["block"], "breaks", "earlier", inclusive=False, max_group=max_group)
    cut = blocks.join(numbered, ["url", "block"]).withColumn("dists", F.slice("dists", F.lit(1), F.size("sents") - 1))
    last = F.size("segments") - 1
    chunks = F.transform(
        "segments",
        lambda seg, i: F.struct(
            (F.col("earlier") + i).cast("int").alias("ordinal"), ((i == 0) | (i == last)).alias("edge"),
            F.array_join(F.slice("sents", seg.start, seg.length), " ").alias("text"),
            F.array_join(F.slice("codes", seg.start, seg.length), "").alias("codes"),
        ),
    )
    each = cut_lineage(with_segments(cut).select("url", "block", F.inline(chunks)))
    inner = each.where(~F.col("edge")).select("url", "ordinal", "text", "codes")
    pieces = F.sort_array(F.collect_list(F.struct("block", "text", "codes")))
    edges = each.where("edge").groupBy("url", "ordinal").agg(pieces.alias("p")).select(
        "url", "ordinal", F.array_join(F.transform("p", lambda p: p.text), " ").alias("text"),
        F.array_join(F.transform("p", lambda p: p.codes), "").alias("codes"),
    )
    rows = inner.union(edges)
    if "metadata" in parts.columns:
        first = parts.groupBy(F.col(doc).alias("url")).agg(F.min_by("metadata", part).alias("metadata"))
        return chunk_rows(rows.join(first, "url"))
    return chunk_rows(rows.withColumn("metadata", F.lit(None).cast("map<string,string>")))
