"""Language identification by compression.

Method: for every learned language a raw-content zstandard dictionary is cut from sample
texts. A text, in lower case, is encoded with each dictionary, in segments of seg_bytes so that the
dictionary, not the text's own past, decides throughout long texts; the language whose
total is smallest wins. A text without a letter, or null, is `und`. The score is the
relative distance between the best and the second-best size, scaled to 0..1; a text whose
score is below min_score is marked rejected.

The sample is bounded: of each language sample_docs labelled rows, chosen by a seeded hash of the
text, and of each row one piece of piece_chars characters, from a place in the whole text that a hash
chooses. All pieces are used; they are the dictionary. Every row, and every part of it, can be chosen.

Learned on no rows, every text is `und`; learned on one language, every text with a letter
is that language with score 1. Ties go to the language first in name. Null labels teach
nothing. Every row gives one row, also repeated ones.
"""

from __future__ import annotations

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_value, few, tidy

by_value(__name__)

#: A margin of this share of the second-best size counts as certain.
SURE = 0.25


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", sample_docs: int = 256, piece_chars: int = 192, seed: int = 7) -> dict[str, bytes]:
    """{language: dictionary bytes} from a bounded sample of labelled rows: sample_docs pieces of piece_chars characters a language.

    The number of languages bounds what reaches the driver: about twice sample_docs pieces of each. Equal texts count once.
    """
    rows = labelled.where(F.col(lang).isNotNull() & (F.length(text) > 0)).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    # A hash threshold keeps about twice the sample; the exact cut is made on those few rows.
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, 2.0 * sample_docs / n + 64.0 / n))) for k, n in sorted(counts.items())])
    at = F.pmod(F.xxhash64(F.lit(seed), "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    start = F.pmod(F.xxhash64(F.lit(seed + 1), "text"), F.greatest(F.length("text") - piece_chars + 1, F.lit(1))) + 1
    piece = F.substring("text", start.cast("int"), F.lit(piece_chars))
    few = rows.withColumn("at", at).where(F.col("at") < share).select("lang", "at", piece.alias("piece")).distinct()
    chosen: dict[str, list] = {}
    for r in few.sort("lang", "at", "piece").toLocalIterator():
        if len(own := chosen.setdefault(r.lang, [])) < sample_docs:
            own.append(r.piece.lower().encode())
    return {k: b"\n".join(pieces) for k, pieces in chosen.items()}


def classify(texts: list[str | None], dictionaries: dict[str, bytes], level: int, seg_bytes: int) -> list[tuple[str, float, float]]:
    """(language, score, margin): the margin is the bytes by which the second-best is larger."""
    import regex

    letter = regex.compile(r"\p{L}").search
    names = sorted(dictionaries)
    coders = []
    for k in names:
        d = zstandard.ZstdCompressionDict(dictionaries[k], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        coders.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
    base = [len(c.compress(b"")) for c in coders]
    out = []
    for x in texts:
        if not x or not names or not letter(x):
            out.append(("und", 0.0, 0.0))
            continue
        raw = x.lower().encode()
        segments = [raw[i : i + seg_bytes] for i in range(0, len(raw), seg_bytes)]
        sizes = sorted((sum(len(c.compress(s)) - b for s in segments), k) for c, b, k in zip(coders, base, names, strict=True))
        if len(sizes) == 1:
            out.append((sizes[0][1], 1.0, float(sizes[0][0])))
            continue
        margin = sizes[1][0] - sizes[0][0]
        out.append((sizes[0][1], min(1.0, margin / max(1, sizes[1][0]) / SURE), float(margin)))
    return out


def predict(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", level: int = 6, seg_bytes: int = 1024, min_score: float = 0.02) -> DataFrame:
    """Every row with lang_pred, score and rejected; columns of these names are replaced. Only the text is looked at."""
    names = ("lang_pred", "score", "rejected")
    kept = [c for c in docs.columns if c not in names]
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def run(batches):
        for batch in few(batches):
            got = classify(batch.column(text).to_pylist(), dictionaries, level, seg_bytes)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[0] == "und" or g[1] < min_score for g in got], pa.bool_())], names=[*kept, *names])

    return docs.mapInArrow(tidy(run), schema)


def held_out(key: str = "doc_id"):
    """The fifth of the documents that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(True))
