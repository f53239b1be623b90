"""A training corpus from ``documents``: five stages, each by one operator of ``geomill.llm``.

language      documents whose text has no letter, or whose language the network can't tell, go
toxicity      documents that the network takes for toxic (score 0.5 or more) go
near_dedup    one document of each group of near copies (five-word shingles, 0.8 or more) stays
mix           each source is repeated or cut to its target; the document at the cut keeps its
              first words up to the budget
encode        the texts' byte-level BPE ids with their digest, and whether decoding them gives the text

Each function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents, so a repeated document's rows carry no epoch number: they are equal but for
the last, cut one.  A null text is rejected by the first stage; rows without an id pass the third
one by one, rows that repeat an id with other texts are documents of their own; an empty table passes all stages empty.  ``ORACLE_SQL`` is None: SQL can't
express the networks; the stages are tested against brute-force versions in ``tests/llm``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geomill.llm import bpe_codec, language_id, mixing, near_dedup, toxicity
from geomill.llm.common import SMALL_ROWS, Stages, table
from geomill.llm.queries import tokenizer_file, tokenizer_pattern

#: A prediction whose share of the windows' weight is below this counts as "can't tell".
LEAST_SCORE = 0.4

#: Memo entries of the last stage's workers: a quarter of the operator's own, as they share executors that other stages have filled.
MEMO = 50_000

ORACLE_SQL = None


#: Scratch of the stages that have run; a stage removes that of earlier ones, whose output is written by then.
_SCRATCH: list[Stages] = []


def _stages(spark: SparkSession, docs: DataFrame) -> Stages:
    """Scratch for a stage on ``docs``; what earlier stages of this session left goes, unless ``docs`` still reads it."""
    for old in [s for s in _SCRATCH if s.spark is spark and not s.read_by(docs)]:
        old.clear()
        _SCRATCH.remove(old)
    _SCRATCH.append(Stages(spark))
    _SCRATCH[-1].tidy()
    return _SCRATCH[-1]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.learn(language_id.training_rows(docs))
    if not model.labels:  # nothing to learn a language from: only texts without a letter go
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    marked = language_id.identify(docs, model, pred="__lang", score="__score")
    return marked.filter((F.col("__lang") != language_id.UND) & (F.col("__score") >= LEAST_SCORE)).select(*docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _stages(spark, docs)
    net = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_texts(docs, net, score="__score").filter("__score < 0.5").select(*docs.columns)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.one_of_each(docs, _stages(spark, docs), percent=80).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    stages = _stages(spark, docs)
    # ids may be null or repeat; a row's number depends on how the files are split, so it is stored with the row
    rows = stages.keep(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    plan = mixing.draw(mixing.with_sizes(rows.select("doc_id", "source", "text", "__row")).select("doc_id", "source", "size", "__row"), stages)
    plan = stages.keep(plan.filter("taken > 0").select("__row", F.col("size").alias("__size"), F.col("taken").alias("__taken")), "plan")
    stages.clear(rows, plan)
    out = rows.join(F.broadcast(plan) if plan.count() <= SMALL_ROWS else plan, "__row")
    whole = F.array_repeat(F.lit(-1).cast("long"), F.floor(F.col("__taken") / F.col("__size")).cast("int"))
    part = F.col("__taken") % F.col("__size")
    copies = F.concat(whole, F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<long>")))
    out = out.withColumn("__words", F.explode(copies))
    cut = F.col("__words") >= 0
    columns = {"text": F.when(cut, mixing.first_words(F.col("text"), F.col("__words"))).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(cut, F.length(columns["text"])).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.withColumns(columns).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _stages(spark, docs)
    vocabulary, pattern = tokenizer_file("byte_bpe_multi_50k.tiktoken"), tokenizer_pattern()
    out = bpe_codec.encode_digest(docs.select("doc_id", "source", "lang", "text"), vocabulary, pattern, drop=True, with_ids=True, memo=MEMO)
    return out.select("doc_id", "source", "lang", "n_tokens", "ids", "ids_sha256", "decoded_sha256", "round_trip")


STAGES = [("language", language), ("toxicity", toxic), ("near_dedup", dedup), ("mix", mix), ("encode", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again."""
    stages, docs = Stages(spark), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        after = stages.keep(stage(spark, docs, sf_dir), name)
        stages.drop(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
