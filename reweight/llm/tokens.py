"""Token counts: pieces are counted once per distinct pre-token and joined to each document's pre-tokens."""

import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reweight.llm.common import reliable

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
# The broadcast table of frequent pre-tokens: at most so many entries of at most so many characters.
HOT_ENTRIES = 1_000_000
HOT_CHARS = 32
# Pre-tokens that a task counts before it hands the counts on.
FLUSH = 300_000

MARK = "▁"
RUNS = re.compile(r"\n[^ \n]*| +[^ \n]*")
_models: dict = {}


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def processor(path: str):
    """The tokenizer and whether no piece reaches over a word start or a line end."""
    if path not in _models:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        inner = any(MARK in p.lstrip(MARK) or ("\n" in p and len(p) > 1) for p in pieces)
        probe = "a  b  Ａéé ﬁ\tX \n c "
        same = sp.normalize(probe) == MARK + probe.replace(" ", MARK)
        _models[path] = (sp, same and not inner and sp.encode("\n", out_type=str)[0] == MARK)
    return _models[path]


def pre_tokens(text: str, safe: bool) -> Counter:
    """Pre-tokens of a text with their frequencies.

    A pre-token is a run of spaces with the word behind it, or a line end with the word behind it. Its name leaves
    out one leading space, which the tokenizer puts back as its word mark. Where pieces may span words, the text
    itself is the only pre-token.
    """
    if not text:
        return Counter()
    if not safe:
        return Counter([text])
    spaced = " " + text.replace(MARK, " ")
    found = Counter(spaced.replace("\n", " \n").split(" "))
    if found.pop("") == 1:
        return found
    return Counter(t if t[0] == "\n" else t[1:] for t in RUNS.findall(spaced))


def piece_count(sp, name: str, safe: bool) -> int:
    if safe and not name:
        return 1
    return len(sp.encode(name)) - (safe and name[0] == "\n")


def frequencies(path: str):
    """Batches of texts to (name, n): pre-tokens with counts, in parts of bounded size."""

    def run(batches):
        _, safe = processor(path)
        seen: Counter = Counter()

        def part():
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["name", "n"])

        for batch in batches:
            for text in batch.column(0):
                seen.update(pre_tokens(text.as_py(), safe))
                if len(seen) > FLUSH:
                    yield part()
                    seen = Counter()
        yield part()

    return run


def counted(path: str):
    """(name, n) to (name, n, pieces)."""

    def run(batches):
        sp, safe = processor(path)
        for batch in batches:
            pieces = [piece_count(sp, s, safe) for s in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pieces, pa.int64())], ["name", "n", "pieces"])

    return run


def per_document(path: str, hot):
    """(doc_id, text) to one row with the frequent pre-tokens' pieces, and one row for each other pre-token.

    The first row's name starts with two line ends, which no pre-token does; it spreads these rows in the join.
    """

    def run(batches):
        _, safe = processor(path)
        known = hot.value
        for batch in batches:
            ids, keys, names, times, sums, sizes = [], [], [], [], [], []

            def row(i, key, name, n, total, size):
                ids.append(i), keys.append(key), names.append(name), times.append(n), sums.append(total), sizes.append(size)

            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                raw = text.encode()
                key = xxhash.xxh3_64_intdigest(raw) - (1 << 63)
                total = 0
                for name, n in pre_tokens(text, safe).items():
                    pieces = known.get(name)
                    if pieces is None:
                        row(i, key, name, n, 0, None)
                    else:
                        total += n * pieces
                row(i, key, f"\n\n{key:x}", 0, total, len(raw))
                if len(ids) > FLUSH:
                    yield batch_of(ids, keys, names, times, sums, sizes)
                    for c in (ids, keys, names, times, sums, sizes):
                        c.clear()
            yield batch_of(ids, keys, names, times, sums, sizes)

    def batch_of(ids, keys, names, times, sums, sizes):
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        cols = [pa.array(c, k) for c, k in zip((ids, keys, names, times, sums, sizes), kinds)]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "key", "name", "times", "hot", "n_bytes"])

    return run


def frequent(spark: SparkSession, table: DataFrame):
    """A broadcast of the most frequent pre-tokens, and the condition that tells them in the table.

    The least frequency comes from counts per power of two, so the number of entries is bounded without a sort.
    """
    short = F.length("name") <= HOT_CHARS
    level = F.floor(F.log2(F.col("n").cast("double"))).cast("int")
    levels = table.where(short).groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()
    least, total = 64, 0
    for r in sorted(levels, key=lambda r: -r["level"]):
        total += r["n"]
        if total > HOT_ENTRIES:
            break
        least = r["level"]
    is_hot = short & (level >= least)
    rows = table.where(is_hot).select("name", "pieces").toArrow()
    return spark.sparkContext.broadcast(dict(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()))), is_hot


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """`doc_id, n_bytes, n_tokens` for every document, equal to encoding each whole text.

    `docs` needs `doc_id LONG, text`; further columns are ignored. A null text is empty and has no tokens, null ids
    are kept, repeated rows each get a row. Frequent pre-tokens are looked up in a broadcast of bounded size, so
    the shuffled join only meets those that no task sees often. Rows of one document are summed by id and a
    64-bit hash of the text; sums over repeated rows are divided by their number.
    """
    spark = docs.sparkSession
    path = path or model_path()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    seen = texts.select("text").mapInArrow(frequencies(path), "name string, n long")
    table = seen.groupBy("name").agg(F.sum("n").alias("n"))
    table = reliable(table.mapInArrow(counted(path), "name string, n long, pieces long"))
    hot, is_hot = frequent(spark, table)
    rows = texts.mapInArrow(
        per_document(path, hot), "doc_id long, key long, name string, times long, hot long, n_bytes long"
    )
    rare = table.where(~is_hot).select("name", "pieces")
    joined = rows.join(rare, "name", "left")
    pieces = F.col("hot") + F.col("times") * F.coalesce("pieces", F.lit(0))
    sums = joined.groupBy("doc_id", "key").agg(
        F.max("n_bytes").alias("n_bytes"), F.sum(pieces).alias("pieces"), F.count("n_bytes").alias("copies")
    )
    rows = sums.select("doc_id", "n_bytes", F.expr("pieces div copies").alias("n_tokens"), "copies")
    return rows.select("doc_id", "n_bytes", "n_tokens", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).drop("col")


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return count_tokens(docs).withColumn("over_limit", F.col("n_tokens") > LIMIT)
