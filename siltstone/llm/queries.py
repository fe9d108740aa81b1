"""The opN_ queries: each applies its operator to the whole table and derives the contract's columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from siltstone.llm import audit, bpe, convtrie, embeddings, jaccard, language, lines, mixing, packing, pages, rules, warc, weak
from siltstone.llm.stored import stored
from siltstone.sources import table

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op9_mix_sources(spark, sf_dir):
    """doc_id, size, source_size, target and taken words of every document."""
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.size") * F.col("mix.copies")).alias("taken"))


@query
def op6_quality_rules(spark, sf_dir):
    """Rule statistics and the verdict of every document."""
    judged = rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


@query
def op2_ngram_jaccard_join(spark, sf_dir):
    """The near-duplicate class of every document: 4-word shingles, similarity 0.85."""
    return jaccard.ngram_jaccard_join(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


@query
def op3_line_dedup(spark, sf_dir):
    """The text of every document without lines that stand earlier, up to one word."""
    return lines.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


@query
def op8_bpe(spark, sf_dir):
    """Token count and digests of ids and decoded bytes of every document."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    both = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), ranks), ranks)
    return both.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op7_embedding_near_dedup(spark, sf_dir):
    """Links and class of every vector: cosine 0.93 within a label."""
    return embeddings.embedding_near_dedup(table(spark, sf_dir, "embeddings"))


@query
def op4_warc(spark, sf_dir):
    """Writes every page to archives, reads all records back by the index, and describes them."""
    folder = warc.archive_folder(spark)
    records = warc.resolve_revisits(stored(warc.read_warc(warc.write_warc(table(spark, sf_dir, "pages"), folder), folder).drop("payload"), "read"))
    page = lambda c: F.col(c).try_cast("long").alias(c)
    return records.select(page("id").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), page("refers_to"))


@query
def op10_extract_main_text(spark, sf_dir):
    """The article of every page."""
    return pages.extract_main_text(table(spark, sf_dir, "pages"))


@query
def op5_language_id(spark, sf_dir):
    """The language of every document, learned from those with crc32(doc_id) mod 4 other than 2."""
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = language.learn(docs.filter(~held))
    return language.identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


@query
def op1_quality_classifier(spark, sf_dir):
    """Votes, posterior, score and verdict of every document."""
    return weak.quality_classifier(table(spark, sf_dir, "documents"))


@query
def op12_filter_audit(spark, sf_dir):
    """Counts of every order and step of five filters, and each filter's Shapley value, by language."""
    return audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op13_conversation_trie(spark, sf_dir):
    """Every distinct prefix of the conversations, which share the first turns of their hundred's first one."""
    convs, turns = convtrie.with_shared_heads(convtrie.number_turns(table(spark, sf_dir, "conversations")))
    return convtrie.prefix_trie(convs, stored(turns, "rebuilt")).drop("node_id", "parent_id")


@query
def op11_pack_sequences(spark, sf_dir):
    """All documents in sequences of at most 2048 tokens."""
    docs = table(spark, sf_dir, "documents")
    return packing.pack(bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json")))
