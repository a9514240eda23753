"""Delta-maintained token rollups.

A changelog says what became of each document: an insert has counts after the change only,
a delete has counts before it only, a revision has both. Each change becomes one or two signed
rows, and signed rows are added up by source, language and tokenizer version. A batch is one
immutable folder of such partial totals; the rollup is the sum over the committed folders, so a batch
that is committed again changes nothing, and batches may arrive in any order. A batch is written beside
the others and then renamed as a whole: where renaming is atomic (HDFS, local disks) one of two writers
of the same batch wins and the other leaves nothing; what died half-way is read by nobody.

Nulls: a null source or language is a group of its own, a null text has no tokens. An empty
changelog commits an empty batch; a rollup without batches has no rows. Repeated rows count each time
they occur. Texts of any length are taken whole, `piece` of them at a time. Extra columns, whatever their
names, are not read.
"""

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.llm.common import read_table, shared_dir, stored, text_or_empty

KEYS = ["source", "lang", "tokenizer"]
EMAIL = r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"


def load_ranks(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("counts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(df: DataFrame, columns: dict[str, str], tokenizers: dict[str, str | None], piece: int = 200) -> DataFrame:
    """Adds, for each text column c and each tokenizer, the long column columns[c] + "_" + tokenizer.

    A tokenizer with a path is a byte-level BPE of that rank file (read by each Python worker once, so the
    path must be there on the executors); one without counts runs of characters other than white space.
    A null text column gives a null count. Rows are taken `piece` at a time. Equal texts in both columns
    of a row are counted once.
    """
    paths = {t: p for t, p in tokenizers.items() if p}
    kept = df.schema
    out = list(columns.values())
    schema = kept.simpleString()[7:-1] + "".join(f",{o}_{t}:bigint" for o in out for t in paths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = {t: load_ranks(p) for t, p in paths.items()}
        for batch in batches:
            for at in range(0, batch.num_rows, piece):
                part = batch.slice(at, piece)
                texts = [part.column(c).to_pylist() for c in columns]
                arrays, names = list(part.columns), list(part.schema.names)
                for t, e in encoders.items():
                    first: list = []
                    for k, (o, column) in enumerate(zip(out, texts)):
                        if k == 0:
                            counts = first = [None if x is None else len(e.encode_ordinary(x)) for x in column]
                        else:
                            counts = [None if x is None else n if x == y else len(e.encode_ordinary(x)) for x, y, n in zip(column, texts[0], first)]
                        arrays.append(pa.array(counts, pa.int64()))
                        names.append(f"{o}_{t}")
                yield pa.RecordBatch.from_arrays(arrays, names)

    counted = df.mapInArrow(run, schema.replace(":", " ")) if paths else df
    for t in (t for t, p in tokenizers.items() if not p):
        for c, o in columns.items():
            counted = counted.withColumn(f"{o}_{t}", F.regexp_count(F.col(c), F.lit(r"[^\x20\x09-\x0D]+")).cast("long"))
    return counted


def signed_deltas(changes: DataFrame, *carry: str) -> DataFrame:
    """changes: source, lang, tokenizer, n_before, n_after (null: not there before, or after). Gives signed rows of docs and tokens."""
    return changes.select(
        *carry,
        *KEYS,
        F.expr("cast(n_after is not null as int) - cast(n_before is not null as int)").cast("long").alias("docs"),
        (F.coalesce("n_after", F.lit(0)) - F.coalesce("n_before", F.lit(0))).cast("long").alias("tokens"),
    )


class Rollup:
    """Additive totals in a folder of committed batches that any executor and the driver can reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _files(self):
        jvm = self.spark._jvm
        path = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        return path().getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def batches(self) -> list[str]:
        """Names of the committed batches: those whose folder has its marker."""
        files, path = self._files()
        return sorted(x.getPath().getParent().getName()[len("batch=") :] for x in files.globStatus(path("batch=*", "_SUCCESS")) or [])

    def committed(self, batch: str) -> bool:
        files, path = self._files()
        return files.exists(path(f"batch={batch}", "_SUCCESS"))

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Writes the batch's totals once, and says whether it did. A batch folder without its marker is replaced."""
        if not re.fullmatch(r"[\w.-]+", batch):
            raise ValueError("a batch's name has letters, digits, '_', '-' and '.'")
        if self.committed(batch):
            return False
        files, path = self._files()
        draft = f"_draft-{uuid.uuid4().hex}"
        (
            deltas.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
            .where("docs <> 0 or tokens <> 0").coalesce(8)
            .write.parquet(f"{self.path}/{draft}")
        )
        target = path(f"batch={batch}")
        if files.exists(target) and not self.committed(batch):
            files.delete(target, True)
        # Where another writer was first, the rename fails, or puts the draft into its folder, where no reader looks.
        won = not files.exists(target) and files.rename(path(draft), target) and not files.exists(path(f"batch={batch}", draft))
        for left in (path(draft), path(f"batch={batch}", draft)):
            if files.exists(left):
                files.delete(left, True)
        return won

    def totals(self) -> DataFrame:
        """The rollup of all committed batches now; a group without documents or tokens has no row."""
        schema = "source string, lang string, tokenizer string, docs long, tokens long"
        folders = [f"{self.path}/batch={b}" for b in self.batches()]
        rows = self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")

    def foreach_batch(self, stream: str):
        """For writeStream.foreachBatch: a micro-batch of changes that Spark replays is not counted twice. `stream` names the stream and
        its checkpoint; one that starts anew with a new checkpoint takes a new name, as its batches are numbered from zero again."""
        return lambda changes, epoch: self.commit(f"{stream}-{epoch}", signed_deltas(changes))


def change_feed(docs: DataFrame, gone: DataFrame, tokenizers: dict[str, str | None]) -> DataFrame:
    """Three batches over whole tables: every document is loaded; documents with e-mail addresses are revised
    to have them masked; documents whose id is in `gone` are deleted. Rows: batch, keys, n_before, n_after."""
    raw = docs.select("doc_id", "source", "lang", text_or_empty().alias("text"))
    raw = raw.withColumn("masked", F.when(F.instr("text", "@") > 0, F.regexp_replace("text", EMAIL, "<EMAIL>")).otherwise(F.col("text")))
    counted = count_tokens(raw, {"text": "n", "masked": "m"}, tokenizers).drop("text", "masked")
    long = counted.select(
        "doc_id", "source", "lang",
        F.explode(F.array(*[F.struct(F.lit(t).alias("tokenizer"), F.col(f"n_{t}").alias("n"), F.col(f"m_{t}").alias("m")) for t in tokenizers])).alias("c"),
    ).select("doc_id", "source", "lang", "c.*")
    long = long.join(gone.select(F.col("doc_id")).where("doc_id is not null").distinct().withColumn("gone", F.lit(True)), "doc_id", "left")
    none = F.lit(None).cast("long")
    entry = lambda batch, before, after, when: F.when(when, F.struct(F.lit(batch).alias("batch"), before.alias("n_before"), after.alias("n_after")))
    batches = F.array(
        entry("load", none, F.col("n"), F.lit(True)),
        entry("mask", F.col("n"), F.col("m"), F.col("n") != F.col("m")),
        entry("purge", F.col("m"), none, F.col("gone")),
    )
    return long.select(*KEYS, F.explode(F.filter(batches, lambda x: x.isNotNull())).alias("b")).select(*KEYS, "b.*")


def op1_token_rollup(spark: SparkSession, sf_dir: str, bpe_path: str | None = None) -> DataFrame:
    """Rows: source, lang, tokenizer, docs, tokens after loading all documents, masking e-mail addresses, purging
    the documents labelled toxic, and a replay of the masking batch, which changes nothing."""
    import public_tokenizers

    tokenizers = {"byte_bpe_50k": bpe_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "words_1": None}
    gone = read_table(spark, sf_dir, "labels").where("toxic = 1")
    feed = change_feed(read_table(spark, sf_dir, "documents"), gone, tokenizers)
    signed = signed_deltas(feed, "batch")
    # The partial totals of all batches at once, so that the texts are read and counted one time.
    partial = stored(signed.groupBy("batch", *KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")), "op1")
    rollup = Rollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    for batch in ("load", "mask", "purge", "mask"):
        rollup.commit(batch, partial.where(F.col("batch") == batch))
    return rollup.totals()
