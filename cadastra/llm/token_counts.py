"""Token counts by a two-tier lookup that never shuffles pre-tokens.

A text is cut before each run of spaces, where no piece of the vocabulary can reach across, so the
count of a text is the sum over its pre-tokens. Tier one is a broadcast table of the lengths of
frequent pre-tokens: those that repeat in a bounded sample drawn over the whole table, and those that the
vocabulary holds as one piece, which its training made a piece because they are frequent. The sample
decides where a length is looked up, never what it is. Tier two is a cache in each worker of what the
library gave for all others; it is bounded too and dropping an entry costs time only.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_rows, renamed, utf8_length

SPACE = "▁"  # the library's own sign for a space
CACHE_ENTRIES = 300_000
CACHED_CHARS = 64  # longer pre-tokens are encoded but not kept
SAMPLE_ROWS, SAMPLE_BYTES = 2_000, 1 << 16  # of the sample: rows, and bytes of a text that enters it
FREQUENT_ENTRIES = 50_000  # counted pre-tokens in the table, beside those of the vocabulary

_cut = re.compile(" +[^ ]*")
_models: dict[str, sentencepiece.SentencePieceProcessor] = {}
_caches: dict[str, tuple[dict, dict]] = {}


def model(path: str) -> sentencepiece.SentencePieceProcessor:
    if path not in _models:
        _models[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _models[path]


def frequent_words(df: DataFrame, text_column: str, rows: int) -> list[str]:
    """The pre-tokens that repeat in about ``rows`` rows drawn from all of ``df``, the most frequent first; counted in tasks."""
    n = df.count() if rows else 0
    if not n:
        return []
    text = F.col(text_column)
    drawn = df.sample(min(1.0, rows / n), seed=0).where(F.octet_length(text) <= SAMPLE_BYTES).select(text_column)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for sample in batch.column(0).to_pylist():
                counts.update(w for w in pre_tokens(sample) if 0 < len(w) <= CACHED_CHARS)
        yield {"word": list(counts), "n": list(counts.values())}

    counted_words = arrow_rows(drawn, make, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    return [r.word for r in counted_words.orderBy(F.desc("n"), "word").limit(FREQUENT_ENTRIES).collect()]


def frequent_lengths(path: str, counted_words: Iterable[str] = ()) -> dict[str, int]:
    """Lengths of ``counted_words`` and of the pre-tokens that are one piece of the vocabulary."""
    sp = model(path)
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
    words = [p[1:] for p in pieces if p.startswith(SPACE) and SPACE not in p[1:] and len(p) > 1]
    words = list(dict.fromkeys([*words, *counted_words]))
    return dict(zip(words, map(len, sp.encode(words, num_threads=1))))


def splittable(path: str) -> bool:
    """Whether no piece reaches from a non-space to a space, and a text gets a space put before it, nothing else."""
    sp = model(path)
    inside = re.compile(f"[^{SPACE}]{SPACE}")
    plain = sp.encode("a  b ", out_type=str) and "".join(sp.encode("a  b ", out_type=str)) == f"{SPACE}a{SPACE}{SPACE}b{SPACE}"
    return plain and not any(inside.search(sp.id_to_piece(i)) for i in range(sp.get_piece_size()))


def pre_tokens(text: str) -> list[str]:
    """Each is what follows the space that the library puts or finds before it."""
    text = text.replace(SPACE, " ")
    if "  " not in text and text[:1] != " " and text[-1:] != " ":
        return text.split(" ")
    return [x[1:] for x in _cut.findall(" " + text)]


def counted(texts: list[str | None], frequent: dict[str, int], path: str) -> list[int]:
    """The number of tokens of each text; null and empty texts have none."""
    sp = model(path)
    if path not in _caches:
        _caches[path] = ({}, {})
    young, old = _caches[path]
    out = []
    for text in texts:
        if not text:
            out.append(0)
            continue
        words = pre_tokens(text)
        lengths = list(map(frequent.get, words))
        missed = [word for word, length in zip(words, lengths) if length is None]
        total = sum(filter(None, lengths))
        if missed:
            lengths = list(map(young.get, missed))
            total += sum(filter(None, lengths))
            missed = [word for word, length in zip(missed, lengths) if length is None]
        if missed:
            fresh = {}
            for word in missed:
                length = old.get(word)
                if length is None:
                    fresh[word] = fresh.get(word, 0) + 1
                else:
                    young[word] = length
                    total += length
            for word, ids in zip(fresh, sp.encode(list(fresh), num_threads=1)):
                length = len(ids) if word else 1  # the empty one is a lone space, which is a token
                total += fresh[word] * length
                if len(word) <= CACHED_CHARS:
                    young[word] = length
            if len(young) > CACHE_ENTRIES:
                young, old = {}, young
                _caches[path] = (young, old)
        out.append(total)
    return out


def count_tokens(df: DataFrame, model_path: str, id_columns: tuple[str, ...] = ("doc_id",), text_column: str = "text", limit: int = 4096, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``id_columns``, then n_bytes, n_tokens (long) and over_limit (n_tokens > ``limit``), a row for each row.

    Whole texts as the library encodes them without begin or end tokens. A null text counts as empty;
    rows with null or repeated ids stay rows of their own; an empty table gives an empty table; other
    columns, whatever their names, are ignored. Map-side only: no pre-token of the count is shuffled.
    ``sample_rows`` is the size of the sample of frequent pre-tokens, which one job draws and counts; any
    number, 0 included, gives the same counts. A task holds 256 texts and their pre-tokens at a time.
    """
    if not splittable(model_path):
        raise ValueError("this model's pieces can reach across spaces; its texts can't be cut there")
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        table = shared.value
        for batch in batches:
            n = batch.num_rows
            for lo in range(0, n, 256):  # texts become Python strings few at a time
                part = batch.slice(lo, 256)
                columns = {f"in_{c}": part.column(f"in_{c}") for c in id_columns}
                columns["n_bytes"] = part.column("n_bytes")
                columns["n_tokens"] = counted(part.column(f"in_{text_column}").to_pylist(), table, model_path)
                yield columns

    source = renamed(df, [*id_columns, text_column])
    words = frequent_words(source, f"in_{text_column}", sample_rows)
    shared = df.sparkSession.sparkContext.broadcast(frequent_lengths(model_path, words))
    source = source.withColumn("n_bytes", utf8_length(F.col(f"in_{text_column}")))
    schema = T.StructType([T.StructField(f"in_{c}", kinds[c]) for c in id_columns] + [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    out = arrow_rows(source, make, schema)
    return out.select(*(F.col(f"in_{c}").alias(c) for c in id_columns), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
