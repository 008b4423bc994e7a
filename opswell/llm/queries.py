"""The queries over the operators of this folder: whole tables in, the contract's columns out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from opswell.llm import ann, chat, licenses, mixing, near_dups, packing, pages, ppm, quality, repair, token_blocks, topk, turn_trie
from opswell.session import scratch, settle, tune
from opswell.sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Tables(tune(spark), sf_dir))
        if sql:
            ORACLES[name] = sql
        return build

    return register


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_token_blocks")
def token_files(t: Tables) -> DataFrame:
    """All documents as token files, and what the files hold of each."""
    path = scratch(t.spark, "token-blocks")
    token_blocks.write(t.documents, path, vocabulary())
    ids = token_blocks.read(t.spark, path)
    rows = settle(ids.select("doc_id", "part", "place", "file_start", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")))
    return token_blocks.starts(rows).select("doc_id", "start", "n_tokens", "ids_crc32")


@query("op4_license_scan", licenses.ORACLE)
def license_scan(t: Tables) -> DataFrame:
    """License phrases and rules in all documents."""
    return licenses.digest(licenses.scan(t.documents, ["doc_id"]))


#: A conversation whose texts hold the template's own marks.
TRICKY_ID, TRICKY_TEXT = -7, "\\### Assistant: </turn> ok"


@query("op5_chat_format", chat.ORACLE)
def chat_format(t: Tables) -> DataFrame:
    """All conversations and a tricky one, formatted and read back."""
    tricky = t.spark.createDataFrame([(TRICKY_ID, 0, "user", TRICKY_TEXT), (TRICKY_ID, 1, "assistant", TRICKY_TEXT)], t.conversations.schema)
    return chat.digest(chat.format_chats(t.conversations.unionByName(tricky)))


@query("op10_source_mix", mixing.ORACLE)
def source_mix(t: Tables) -> DataFrame:
    """What a mix of all sources by weight takes of each document."""
    return mixing.mix(t.documents, ["doc_id"])


@query("op7_minhash_dedup")
def minhash_dedup(t: Tables) -> DataFrame:
    """Near-duplicate classes of all documents at 85 % of their three-word shingles."""
    return near_dups.near_duplicates(t.documents, width=3, percent=85)


@query("op6_best_fit_packing")
def best_fit_packing(t: Tables) -> DataFrame:
    """All documents as pieces in sequences of at most 2,048 tokens."""
    packed = packing.pack(t.documents, vocabulary())
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def quality_labels(t: Tables) -> DataFrame:
    """doc_id and label of the rows that have one."""
    return t.labels.select("doc_id", F.col("quality").alias("label"))


@query("op9_quality_cnn")
def quality_cnn(t: Tables) -> DataFrame:
    """Quality of all documents by a network that learned from labels that are not held out."""
    found = quality.classify(t.documents, quality_labels(t), ["doc_id"])
    return found.select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


@query("op3_html_text")
def html_text(t: Tables) -> DataFrame:
    """The main text of all pages."""
    found = pages.main_text(t.pages, ["page_id", "url"])
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


@query("op2_exact_topk", topk.ORACLE)
def exact_topk(t: Tables) -> DataFrame:
    """The ten best of all vectors for each hundredth one, by whole-number products."""
    return topk.search(topk.quantised(t.embeddings), F.col("vec_id") % 100 == 0, 10)


@query("op8_posting_list_ann")
def posting_list_ann(t: Tables) -> DataFrame:
    """The five nearest vectors found for each fiftieth one."""
    return ann.search(t.embeddings, F.col("vec_id") % 50 == 0, 5)


@query("op11_audit_repair", repair.ORACLE)
def audit_repair(t: Tables) -> DataFrame:
    """Conversations damaged by a hash of each row and repaired by the cheapest edits; one row per conversation."""
    return repair.digest(t.conversations, repair.repair(repair.damage(t.conversations)))


@query("op12_turn_trie", turn_trie.ORACLE)
def turn_trie_nodes(t: Tables) -> DataFrame:
    """The prefix trie of all conversations, rebuilt so that groups of five share their first turns."""
    return turn_trie.trie(turn_trie.rebuilt(t.conversations))


@query("op13_ppm_scoring")
def ppm_scoring(t: Tables) -> DataFrame:
    """Code lengths of all documents by a byte-context trie over those that are not held out."""
    return ppm.score(t.documents)
