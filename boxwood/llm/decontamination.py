"""Benchmark decontamination by a positional inverted index, with DataFrame functions only.

The index has a posting (document, position) for each place of each term of
the test items in the training documents. A window of an item is ``width``
consecutive words, or the whole of a shorter item. Its lists are intersected
from its rarest term on:

1. the rarest term of each window is its anchor; anchors are joined with the
   postings of their terms only, which gives candidates: a document and a place;
2. the lists of the second rarest terms are shifted by the distance from the
   anchor and must hold a posting there, or up to ``slop`` places from there;
3. of documents that still have candidates, the postings of all terms around
   the anchor are shifted and intersected; what each list adds is a bit, and
   the bits of a candidate are or-ed.

A window all of whose bits come from unshifted places is a phrase match; one
that has its anchor and all other words within ``slop`` places of theirs is a
proximity match. An anchor lies in windows of up to 2 * width - 1 words, so
the bits fit into a long and nothing grows with an item's length.

Documents are named by 96 bits of hashes of id and text, so rows of one id but
different texts stay apart.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boxwood.llm.common import discard, durable, quoted, table

#: Fixed value: the word pattern of the contract, for texts with A-Z lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WIDTH, SLOP = 10, 2
#: Tables of at most so many rows (a few dozen bytes each) are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 250_000
_DOC = ["k1", "k2"]


def _lowered(text: Column) -> Column:
    """A-Z in lower case, all other characters as they are."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def terms_of(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(_lowered(text), F.lit(TERM), F.lit(0)), F.array().cast("array<string>"))


def _small(df: DataFrame) -> DataFrame:
    """df (a written table), to be broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(quoted(text_col)).cast("string")
    return df.select(F.col(quoted(id_col)).alias("doc_id"), text.alias("text"), F.xxhash64(F.col(quoted(id_col)), text).alias("k1"), F.hash(text).alias("k2"))


def test_terms(items: DataFrame, item_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(item, item_id, q, word, n) for each word of each item, and (term, word) for each different word."""
    numbered = durable(items.select(F.col(quoted(item_col)).alias("item_id"), terms_of(F.col(quoted(text_col)).cast("string")).alias("words")).filter(F.size("words") > 0).withColumn("item", F.monotonically_increasing_id()))
    places = numbered.select("item", "item_id", F.size("words").alias("n"), F.posexplode("words").alias("q", "word"))
    return places, durable(places.select("word").distinct().withColumn("term", F.monotonically_increasing_id()))


def positional_index(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings (k1, k2, pos, term) of the terms (word, term) in the documents' whole texts; written, in the order of the documents."""
    words = documents.select(*_DOC, F.posexplode(terms_of(F.col("text"))).alias("pos", "word"))
    return durable(words.join(_small(terms), "word").select(*_DOC, "pos", "term"))


def _anchors(places: DataFrame, terms: DataFrame, index: DataFrame, width: int) -> DataFrame:
    """A row for each place of an item that is the rarest of a window, the first of them on ties.

    ``low`` is the first place around it, ``around`` the terms from there on,
    ``windows`` where its windows begin, ``seconds`` their second rarest places.
    """
    often = index.groupBy("term").agg(F.count("*").alias("often"))
    known = places.join(terms, "word").join(often, "term", "left").withColumn("often", F.coalesce("often", F.lit(0)))
    along = Window.partitionBy("item").orderBy("q")
    reach = width - 1
    at = known.select(
        "item", "item_id", "n", "q", "term",
        F.array_sort(F.collect_list(F.struct("often", "q")).over(along.rowsBetween(0, reach))).alias("rare"),
        F.collect_list("term").over(along.rowsBetween(-reach, reach)).alias("around"),
    )
    windows = at.filter(F.col("q") <= F.greatest(F.col("n") - width, F.lit(0)))
    windows = windows.filter(F.col("rare")[0]["often"] > 0)  # else a word of it is nowhere
    chosen = windows.groupBy("item", F.col("rare")[0]["q"].alias("q")).agg(F.collect_set("q").alias("windows"), F.collect_set(F.get("rare", F.lit(1))["q"]).alias("seconds"))
    own = at.select("item", "item_id", "n", "q", "term", "around", F.greatest(F.col("q") - reach, F.lit(0)).alias("low"))
    return durable(own.join(chosen, ["item", "q"]).withColumn("anchor", F.monotonically_increasing_id()))


def _candidates(index: DataFrame, anchors: DataFrame, slop: int) -> DataFrame:
    """(k1, k2, anchor, pos): an anchor's posting with one of a second term in its place, or near it."""
    firsts = durable(index.join(_small(anchors.select("anchor", "term")), "term").select(*_DOC, "anchor", "pos"))
    second = anchors.select("anchor", F.col("q").alias("q1"), "low", "around", F.explode("seconds").alias("q2"))
    second = durable(second.select("anchor", (F.col("q2") - F.col("q1")).alias("apart"), F.col("around")[F.col("q2") - F.col("low")].alias("term")))
    wanted = firsts.join(_small(second), "anchor").select(*_DOC, "anchor", F.col("pos").alias("at"), "term", "apart")
    wanted = wanted.withColumn("pos", F.explode(F.sequence(F.col("at") + F.col("apart") - slop, F.col("at") + F.col("apart") + slop)))
    lists = index.join(_small(durable(second.select("term").distinct())), "term", "left_semi")
    met = wanted.join(lists, [*_DOC, "term", "pos"], "left_semi").select(*_DOC, "anchor", F.col("at").alias("pos"))
    alone = durable(anchors.filter(F.size("seconds") == 0).select("anchor"))  # windows of one word
    alone = firsts.join(_small(alone), "anchor", "left_semi")
    out = durable(met.unionByName(alone).distinct())
    discard(firsts)
    return out


def find_passages(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH, slop: int = SLOP) -> DataFrame:
    """k1, k2 (the document), item, item_id, start, length, phrase: a row for each window of an item found in a document.

    phrase is true where the window's words follow each other as in the item;
    false where the anchor's other words lie within slop places of theirs.
    Null and empty texts have no words. Rows with equal id and text are one
    document here. An empty table on either side gives an empty result.
    """
    docs = _documents(documents, id_col, text_col)
    places, terms = test_terms(items, item_col, item_text_col)
    index = positional_index(docs, terms)
    anchors = _anchors(places, terms, index, width)
    found = _candidates(index, anchors, slop)
    # All lists around the anchors of what is left.
    near = index.join(_small(durable(found.select(*_DOC).distinct())), _DOC, "left_semi")
    some = _small(anchors)
    wanted = found.join(some, "anchor").select(*_DOC, "anchor", F.col("pos").alias("at"), (F.col("pos") - F.col("q") + F.col("low")).alias("from"), F.posexplode("around").alias("bit", "term"))
    wanted = wanted.withColumn("off", F.explode(F.sequence(F.lit(-slop), F.lit(slop)))).withColumn("pos", F.col("from") + F.col("bit") + F.col("off"))
    one = F.expr("shiftleft(1L, bit)")
    bits = wanted.join(near, [*_DOC, "term", "pos"]).groupBy(*_DOC, "anchor", "at").agg(F.bit_or(F.when(F.col("off") == 0, one).otherwise(F.lit(0).cast("long"))).alias("exact"), F.bit_or(one).alias("near"))
    each = bits.join(some, "anchor").select(*_DOC, "item", "item_id", "exact", "near", F.least(F.col("n"), F.lit(width)).alias("length"), "low", (F.col("at") - F.col("q")).alias("zero"), F.explode("windows").alias("s"))
    mask = F.expr("shiftleft(shiftleft(1L, length) - 1L, s - low)")
    each = each.withColumn("mask", mask).withColumn("phrase", F.col("exact").bitwiseAND(F.col("mask")) == F.col("mask"))
    each = each.filter(F.col("near").bitwiseAND(F.col("mask")) == F.col("mask"))  # exact bits are near ones, too
    out = durable(each.select(*_DOC, "item", "item_id", (F.col("zero") + F.col("s")).alias("start"), "length", "phrase"))
    discard(index, found)
    return out


def decontaminate(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH, slop: int = SLOP) -> DataFrame:
    """A row for each row of documents: id, n_words, n_hit (words inside phrase matches), items and near_items (sorted ids as strings).

    near_items are the items with a phrase or a proximity match. Null and
    empty texts have no words and match nothing; an item with a null id is named
    "null"; items with one id are one item with the windows of all their texts.
    Repeated rows each get their row. Very long texts are searched whole. Other columns,
    whatever their names, are not read; an empty table of documents gives an empty
    result, one of items no matches.
    """
    found = find_passages(documents, items, id_col, text_col, item_col, item_text_col, width, slop)
    hits = found.filter("phrase").select(*_DOC, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("pos")).distinct().groupBy(*_DOC).agg(F.count("*").alias("n_hit"))
    named = found.select(*_DOC, F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("name"), "phrase").groupBy(*_DOC, "name").agg(F.max("phrase").alias("phrase"))
    lists = named.groupBy(*_DOC).agg(F.array_sort(F.collect_list(F.when(F.col("phrase"), F.col("name")))).alias("items"), F.array_sort(F.collect_list("name")).alias("near_items"))
    none = F.array().cast("array<string>")
    slim = _documents(documents, id_col, text_col).select("doc_id", *_DOC, F.coalesce(F.regexp_count(_lowered(F.col("text")), F.lit(TERM)), F.lit(0)).cast("long").alias("n_words"))
    out = slim.join(hits, _DOC, "left").join(lists, _DOC, "left")
    return out.select(F.col("doc_id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("near_items", none).alias("near_items"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), F.size("near_items").cast("long").alias("n_near_items"))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
t AS (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS pos FROM d),
often AS (SELECT word, count(*) AS n FROM t GROUP BY word),
s AS (SELECT item_id, w, least(10, len(w)) AS size, unnest(range(greatest(len(w) - 10, 0) + 1)) AS s FROM i WHERE len(w) > 0),
p AS (SELECT item_id, s, size, unnest(range(size)) AS k, unnest(w[s + 1 : s + size]) AS word FROM s),
f AS (SELECT p.*, coalesce(n, 0) AS n FROM p LEFT JOIN often USING (word)),
a AS (SELECT item_id, s, size, arg_min(struct_pack(k := k, word := word), struct_pack(n := n, k := k)) AS rare FROM f GROUP BY ALL),
c AS (SELECT a.item_id, a.s, a.size, t.r, t.pos - a.rare.k AS zero FROM a JOIN t ON t.word = a.rare.word),
b AS (
  SELECT c.item_id, c.s, c.size, c.r, c.zero, p.k, bool_or(t.pos = c.zero + p.k) AS exact
  FROM c JOIN p ON p.item_id = c.item_id AND p.s = c.s JOIN t ON t.r = c.r AND t.word = p.word AND t.pos BETWEEN c.zero + p.k - 2 AND c.zero + p.k + 2
  GROUP BY ALL),
m AS (SELECT item_id, s, size, r, zero, bool_and(exact) AS phrase FROM b GROUP BY item_id, s, size, r, zero HAVING count(*) = size),
h AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(zero, zero + size)) AS pos FROM m WHERE phrase) GROUP BY r),
o AS (
  SELECT r, count(*) FILTER (phrase) AS n_items, string_agg(item_id, ',' ORDER BY item_id) FILTER (phrase) AS items, count(*) AS n_near_items
  FROM (SELECT r, CAST(item_id AS VARCHAR) AS item_id, bool_or(phrase) AS phrase FROM m GROUP BY ALL) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near_items, 0) AS n_near_items
FROM d LEFT JOIN h USING (r) LEFT JOIN o USING (r)
"""
