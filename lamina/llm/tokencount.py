"""Token counts of whole texts, with overlap resynchronisation for huge documents.

Texts of up to chunk_chars are encoded whole. A longer text is encoded in overlapping
chunks with offsets. Two neighbouring encodings are spliced at a boundary inside their
overlap that both have and that is proven stable: a cut beside an ASCII space or digit,
which no pre-token of the vocabulary's pattern spans and no normalisation joins with its
neighbours, with the same tokens on both sides. If the overlap has none, as in a long run
of letters, the overlap is widened (doubled, up to the rest of the text) and encoded
again. So memory is bounded by a chunk except where a text has no stable boundary at all.

Texts that are null count as empty: no bytes and no tokens. Every row gives one row, also
repeated ones; an empty table gives none.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_value, few, tidy

by_value(__name__)

STABLE = frozenset(" \t\n\r0123456789")


def load_counter(path: str):
    """(whole, spans): token counts of a list of texts, and (tokens, starts, ends) of one text with character offsets."""
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)], None
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()

    def spans(text):
        e = t.encode(text, add_special_tokens=False)
        return e.ids, e.offsets

    return lambda texts: [len(x) for x in t.encode_batch_fast(texts, add_special_tokens=False)], spans


def splice(text: str, low: int, high: int, left, right):
    """A stable cut in text[low:high] on which the encodings left and right of it agree, or None.

    left and right are (ids, absolute offsets). The cut nearest the middle wins. At a cut
    every token of both lies wholly on one side, and the tokens within the overlap on each
    side of it are the same in both, up to the first or last that the overlap's ends touch.
    """
    a = [(i, s, e) for i, (s, e) in zip(*left, strict=True) if e > low]
    b = [(i, s, e) for i, (s, e) in zip(*right, strict=True) if s < high]
    mid = (low + high) // 2
    for d in range((high - low) // 2):
        for p in {mid + d, mid - d}:
            if not low + 1 < p < high - 1 or not (text[p - 1] in STABLE or text[p] in STABLE):
                continue
            if any(s < p < e for _, s, e in a) or any(s < p < e for _, s, e in b):
                continue
            near = max(low + 1, p - 64), min(high - 1, p + 64)
            inside = [[x for x in y if near[0] < x[1] and x[2] < near[1]] for y in (a, b)]
            if inside[0] == inside[1] and inside[0]:
                return p
    return None


def count_chunked(text: str, spans, chunk: int, overlap: int) -> int:
    """The tokens of text, encoded in overlapping chunks of about `chunk` characters."""
    total, at, end = 0, 0, min(chunk, len(text))
    left, start = spans(text[:end]), 0
    while end < len(text):
        wide = overlap
        while True:
            low = max(at, end - wide)
            new_end = min(len(text), low + chunk + wide)
            right = spans(text[low:new_end])
            p = splice(text, low, end, _moved(left, start), _moved(right, low))
            if p is not None:
                total += sum(s + start >= at and e + start <= p for s, e in left[1])
                left, start, at, end = right, low, p, new_end
                break
            if low == at:  # nothing stable in all that is left of this chunk: lengthen the chunk itself
                end = min(len(text), end + wide)
                left, start = spans(text[at:end]), at
                if end == len(text):
                    break
            wide *= 2
    return total + sum(s + start >= at for s, _ in left[1])


def _moved(encoding, by: int):
    return encoding[0], [(s + by, e + by) for s, e in encoding[1]]


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text", limit: int = 2048, chunk_chars: int = 1 << 16, overlap_chars: int = 1 << 10, batch_chars: int = 1 << 20) -> DataFrame:
    """Every row with n_bytes, n_tokens and over_limit (n_tokens > limit); columns of these names are replaced.

    vocabulary is a path that every executor has: a .json file of the tokenizers library or
    a .model file of sentencepiece (which gives no offsets here, so it encodes texts whole).
    """
    names = ("n_bytes", "n_tokens", "over_limit")
    kept = [c for c in docs.columns if c not in names]
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches):
        whole, spans = load_counter(vocabulary)
        for batch in few(batches):
            texts = [x or "" for x in batch.column(text).to_pylist()]
            counts, held, size = [0] * len(texts), [], 0
            for k, x in enumerate(texts):
                if spans and len(x) > chunk_chars:
                    counts[k] = count_chunked(x, spans, chunk_chars, overlap_chars)
                elif x:
                    held.append(k)
                    size += len(x)
                if held and (size >= batch_chars or k == len(texts) - 1):
                    for j, n in zip(held, whole([texts[j] for j in held]), strict=True):
                        counts[j] = n
                    held, size = [], 0
            if held:
                for j, n in zip(held, whole([texts[j] for j in held]), strict=True):
                    counts[j] = n
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())], names=[*kept, *names])

    return docs.mapInArrow(tidy(run), schema)


def digest(docs: DataFrame, vocabulary: str, **kw) -> DataFrame:
    return count_tokens(docs.select("doc_id", "text"), vocabulary, **kw).select("doc_id", "n_bytes", "n_tokens", F.col("over_limit"))
