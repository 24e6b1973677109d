"""Exact keyword ranking that skips documents which can't reach a question's best k.

Postings lie in blocks of documents of similar length.  A block keeps, for every term in it, the largest term frequency and the
smallest length, which bound the term's contribution to any of its documents under whatever statistics are asked for.
A question's blocks of highest bound give it a threshold, the k-th best score found there.  Only blocks whose bound reaches it
are looked at again, only documents with a term that its weaker terms together don't outweigh become candidates, and
only candidates are scored.  The result is that of scoring everything.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loresmith.config import RETRIEVAL, RetrievalConfig
from loresmith.operators.keyword import DOCUMENT_MARK, inverse_document_frequency, postings_of, query_terms, rank_scores
from loresmith.session import broadcast_if_small, written

BLOCK_DOCS = 32  # documents of a block, about
CLASSES = 4  # classes of document length for each doubling
FIRST_BLOCKS = 4  # blocks, beyond k, that give a question its threshold
MARGIN = 1e-6  # bounds within this much of a threshold count as reaching it: scores are ranked to nine decimals


@dataclass(frozen=True)
class BlockIndex:
    """postings(facet, block, doc_id, dl, term, tf), blocks(facet, block, term, max_tf, min_dl), stats(facet, term, df, dl).

    ``stats`` may have several rows of a facet and term, to be added up, negative ones too; the row of the document mark counts
    the documents and their total length.  A facet is a value of the documents' metadata by which questions are restricted.
    """

    postings: DataFrame
    blocks: DataFrame
    stats: DataFrame

    def only(self, facets: Sequence[str]) -> "BlockIndex":
        """The index of the documents of the given facets: their statistics, without reading a text."""
        return replace(self, **{
            name: getattr(self, name).where(F.col("facet").isin(list(facets))) for name in ("postings", "blocks", "stats")})

    @property
    def corpus(self) -> DataFrame:
        """One row: number of documents and their mean length."""
        marks = self.stats.where(F.col("term") == DOCUMENT_MARK)
        return marks.agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n_docs"), F.try_divide(F.sum("dl"), F.sum("df")).alias("avgdl"))

    def terms_among(self, vocabulary: DataFrame) -> DataFrame:
        """term, df, idf, avgdl of the given terms (all, if null) that some document holds."""
        stats = self.stats.where(F.col("term") != DOCUMENT_MARK)
        if vocabulary is not None:
            stats = stats.join(broadcast_if_small(vocabulary), "term", "left_semi")
        counts = stats.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        whole = self.corpus.select(F.struct("n_docs", "avgdl")).scalar()
        idf = inverse_document_frequency(whole["n_docs"], F.col("df"))
        return counts.select("term", "df", idf.alias("idf"), whole["avgdl"].alias("avgdl"))


def with_blocks(postings: DataFrame, salt: str = "", block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Add ``block``: a hash of the facet, the class of the document's length, and a slot of about ``block_docs`` documents."""
    size = F.floor(CLASSES * F.log2(F.col("dl") + 1.0))
    docs = postings.where(F.col("term") == DOCUMENT_MARK).groupBy("facet", size.alias("class")).agg(F.count("*").alias("n"))
    slots = written(docs.select("facet", "class", F.ceil(F.col("n") / block_docs).alias("slots")), "block-slots")
    rows = postings.withColumn("class", size).join(broadcast_if_small(slots), ["facet", "class"])
    slot = F.pmod(F.xxhash64("doc_id"), F.col("slots"))
    return rows.withColumn("block", F.xxhash64(F.lit(salt), "facet", "class", slot)).drop("class", "slots")


def block_bounds(postings: DataFrame) -> DataFrame:
    named = postings.where(F.col("term") != DOCUMENT_MARK)
    return named.groupBy("facet", "block", "term").agg(F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"))


def term_stats(postings: DataFrame) -> DataFrame:
    mark = F.col("term") == DOCUMENT_MARK
    return postings.groupBy("facet", "term").agg(
        F.count("*").alias("df"), F.sum(F.when(mark, F.col("dl")).otherwise(0)).alias("dl"))


def faceted_postings(corpus: DataFrame, id_col: str = "doc_id", text_col: str = "text", facet_col: str | None = None) -> DataFrame:
    """(facet, doc_id, dl, term, tf) in one pass over the texts; a null facet is ''."""
    facet = F.coalesce(F.col(facet_col).cast("string"), F.lit("")) if facet_col else F.lit("")
    keyed = corpus.select(F.struct(F.col(id_col).alias("id"), facet.alias("facet")).alias("doc_id"), F.col(text_col).alias("text"))
    rows = postings_of(keyed)
    return rows.select("doc_id.facet", F.col("doc_id.id").alias("doc_id"), "dl", "term", "tf")


def build_block_index(
    corpus: DataFrame, id_col: str = "doc_id", text_col: str = "text", facet_col: str | None = None, block_docs: int = BLOCK_DOCS,
) -> BlockIndex:
    """Index a corpus with unique ids; a search reads only the tables written here."""
    plain = written(faceted_postings(corpus, id_col, text_col, facet_col), "faceted-postings")
    postings = written(with_blocks(plain, block_docs=block_docs), "block-postings")
    return BlockIndex(postings, written(block_bounds(postings), "block-bounds"), written(term_stats(postings), "term-stats"))


def _weight(cfg: RetrievalConfig, tf: str, dl: str) -> Column:
    """A term's contribution; it grows with the frequency and falls with the length."""
    norm = 1.0 - cfg.bm25_b + cfg.bm25_b * F.col(dl) / F.col("avgdl")
    return F.col("idf") * (F.col(tf) * (cfg.bm25_k1 + 1.0)) / (F.col(tf) + cfg.bm25_k1 * norm)


@dataclass(frozen=True)
class Search:
    """One search, step by step: every table is written or a few rows a question, so that steps can be looked at."""

    index: BlockIndex
    cfg: RetrievalConfig
    weighted: DataFrame  # query_id, term, idf, avgdl
    bounds: DataFrame  # query_id, block, bound

    def partial_scores(self, blocks: DataFrame, terms: DataFrame) -> DataFrame:
        """(query_id, block, chunk_id, score): what ``terms`` (a part of ``weighted``) give to the documents of (query_id, block)."""
        asked = blocks.select("query_id", "block").join(broadcast_if_small(terms), "query_id")
        found = self.index.postings.drop("facet").join(broadcast_if_small(asked), ["block", "term"])
        return found.groupBy("query_id", "block", F.col("doc_id").alias("chunk_id")).agg(
            F.sum(_weight(self.cfg, "tf", "dl")).alias("score"))

    def completed(self, pairs: DataFrame, terms: DataFrame) -> DataFrame:
        """(query_id, chunk_id, bm25_score): ``pairs`` (query_id, block, chunk_id, score) with what ``terms`` add to them."""
        asked = pairs.select("query_id", "block", F.col("chunk_id").alias("doc_id")).join(broadcast_if_small(terms), "query_id")
        found = self.index.postings.drop("facet").join(broadcast_if_small(asked), ["block", "doc_id", "term"])
        more = found.select("query_id", F.col("doc_id").alias("chunk_id"), _weight(self.cfg, "tf", "dl").alias("score"))
        both = pairs.select("query_id", "chunk_id", "score").union(more)
        return both.groupBy("query_id", "chunk_id").agg(F.sum("score").alias("bm25_score"))

    def first_blocks(self, n: int) -> DataFrame:
        w = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
        return self.bounds.withColumn("n", F.row_number().over(w)).where(F.col("n") <= n).drop("n")

    def block_terms(self) -> DataFrame:
        """query_id, block, term, bound: the most that a term gives to a document of a block."""
        rows = self.index.blocks.join(broadcast_if_small(self.weighted), "term")
        return rows.select("query_id", "block", "term", _weight(self.cfg, "max_tf", "min_dl").alias("bound"))

    def with_turn(self, thresholds: DataFrame) -> DataFrame:
        """``weighted`` and whether a term is essential: the weakest terms, whose bounds together miss the threshold, are not."""
        most = self.block_terms().groupBy("query_id", "term").agg(F.max("bound").alias("most"))
        w = Window.partitionBy("query_id").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0)
        summed = most.withColumn("upto", F.sum("most").over(w)).join(broadcast_if_small(thresholds), "query_id", "left")
        reaches = F.col("upto") >= F.coalesce("threshold", F.lit(0.0)) - MARGIN
        return self.weighted.join(summed.select("query_id", "term", reaches.alias("essential")), ["query_id", "term"])


def start_search(wanted: DataFrame, index: BlockIndex, cfg: RetrievalConfig = RETRIEVAL) -> Search:
    """``wanted`` holds (query_id, term).  The parts of the index that any step may look at are those of known terms, written once."""
    terms = index.terms_among(wanted.select("term").distinct())
    weighted = written(wanted.join(terms.select("term", "idf", "avgdl"), "term"), "asked-terms")
    asked = broadcast_if_small(weighted.select("term").distinct())
    index = replace(index, **{
        name: written(getattr(index, name).join(asked, "term", "left_semi"), f"asked-{name}") for name in ("postings", "blocks")})
    search = Search(index, cfg, weighted, weighted)
    return replace(search, bounds=written(
        search.block_terms().groupBy("query_id", "block").agg(F.sum("bound").alias("bound")), "query-blocks"))


def pruned_scores(search: Search, k: int) -> tuple[DataFrame, DataFrame]:
    """Whole scores among which are each question's best k, and the pairs (query_id, block, chunk_id, score) that were begun."""
    first = written(search.first_blocks(k + FIRST_BLOCKS), "first-blocks")
    begun = written(search.partial_scores(first, search.weighted), "first-scores")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    nth = begun.withColumn("n", F.row_number().over(w)).where(F.col("n") == k)
    thresholds = written(nth.select("query_id", F.col("score").alias("threshold")), "thresholds")
    least = F.coalesce("threshold", F.lit(0.0)) - MARGIN
    within = search.bounds.join(broadcast_if_small(thresholds), "query_id", "left").where(F.col("bound") >= least)
    within = within.join(broadcast_if_small(first.select("query_id", "block")), ["query_id", "block"], "left_anti")
    within = written(within, "open-blocks")
    terms = written(search.with_turn(thresholds), "turns")
    weak = terms.where(~F.col("essential")).drop("essential")
    others = written(search.partial_scores(within, terms.where("essential").drop("essential")), "partial-scores")
    # What the weak terms can add in this block decides whether a pair is worth the look.
    added = search.block_terms().join(broadcast_if_small(weak.select("query_id", "term")), ["query_id", "term"], "left_semi")
    added = added.groupBy("query_id", "block").agg(F.sum("bound").alias("added"))
    hopeful = others.join(added, ["query_id", "block"], "left").join(broadcast_if_small(thresholds), "query_id", "left")
    hopeful = hopeful.where(F.col("score") + F.coalesce("added", F.lit(0.0)) >= least)
    hopeful = written(hopeful.select("query_id", "block", "chunk_id", "score"), "hopeful")
    scored = begun.select("query_id", "chunk_id", F.col("score").alias("bm25_score"))
    return scored.union(search.completed(hopeful, weak)), begun.union(others)


def bm25_topk_pruned(
    questions: DataFrame, index: BlockIndex, k: int | None = None, cfg: RetrievalConfig = RETRIEVAL,
    id_col: str = "query_id", text_col: str = "question",
) -> DataFrame:
    """query_id, chunk_id, bm25_score, bm25_rank, bm25_norm, as :func:`keyword.bm25_topk` gives them.

    Empty questions, unknown words and an empty index give no rows.
    """
    k = cfg.bm25_top_k if k is None else k
    search = start_search(query_terms(questions, id_col, text_col), index, cfg)
    return rank_scores(pruned_scores(search, k)[0], k)
