"""Line-first quality rules: judge every line, remove what fails, then reject documents that lose too much.

A line with words fails when it
  * ends without a closing mark (punctuation rule) or shouts: "!!" three times and once in four words,
  * is navigation: two or more words are separators, one word in four or more,
  * is markup: three or more symbol characters, one for every two words or more,
  * is boilerplate: at most ``BOILERPLATE_WORDS`` words and one of the fixed phrases.
Lines without words never fail.  A document is kept when the base rules pass and the failed lines hold at most
``LOSS_PERCENT`` percent of its words.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, map_batches, record

MIN_WORDS = 50
REPEAT_PERCENT = 50
LOSS_PERCENT = 50
BOILERPLATE_WORDS = 40
SYMBOLS = "#*$%&|<>"
CLOSING = ".!?…:;,\"')]}»”’"
SEPARATORS = ("|", "»", "›", ">", "•", "·", "/")
BOILERPLATE = (
    "all rights reserved", "cookie policy", "enable javascript", "lorem ipsum", "privacy policy", "sign in", "log in",
    "subscribe to our newsletter", "terms of service", "terms of use", "use of cookies",
)

_WORDS = re.compile(WORD)
_BLANK = "\x20\t\n\x0b\x0c\r"
_PHRASES = re.compile("|".join(map(re.escape, BOILERPLATE)))
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def repeated_words(words: list[str]) -> int:
    """Words that lie in a three-word window found twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    found = Counter(windows)
    covered, end = 0, 0
    for at, window in enumerate(windows):
        if found[window] > 1:
            covered += at + 3 - max(at, end)
            end = at + 3
    return covered


def line_fails(line: str, words: list[str]) -> bool:
    """Whether a line that has words breaks a rule."""
    n = len(words)
    if words[-1][-1] not in CLOSING:
        return True
    shouts = line.count("!!")
    if shouts >= 3 and shouts * 4 >= n:
        return True
    separators = sum(map(words.count, SEPARATORS))
    if separators >= 2 and separators * 4 >= n:
        return True
    symbols = sum(map(line.count, SYMBOLS))
    if symbols >= 3 and symbols * 2 >= n:
        return True
    return n <= BOILERPLATE_WORDS and _PHRASES.search(line.translate(_UPPER)) is not None


def judge(text: str | None) -> tuple[int, int, int, int, int, int, list[str]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, removed words, kept lines of one text."""
    if not text:
        return 0, 0, 0, 0, 0, 0, []
    words, seen, kept = [], set(), []
    repeated_lines = removed = 0
    for line in text.split("\n"):
        held = _WORDS.findall(line)
        if not held:
            kept.append(line)
            continue
        words += held
        repeated_lines += line in seen
        seen.add(line)
        if line_fails(line, held):
            removed += len(held)
        else:
            kept.append(line)
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), repeated_lines, repeated_words(words), removed, kept


def clean_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text", with_text: bool = True, loss_percent: int = LOSS_PERCENT) -> DataFrame:
    """One row per document with counts, base_failed, kept, n_removed_words and (``with_text``) the cleaned text.

    A null or empty text has no words, so it fails the base rules; its cleaned text is empty.  Repeated rows and
    null keys are judged like any other row; other columns are not read.  An empty table gives no rows.
    """
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words"]

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [judge(t) for t in batch.column(1).to_pylist()]
        columns = {"doc_id": batch.column(0)}
        columns |= {name: ([f[i] for f in found], pa.int64()) for i, name in enumerate(counts)}
        if with_text:
            columns["cleaned"] = (["\n".join(f[6]) for f in found], pa.string())
        return record(**columns)

    read = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = read.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{c} bigint" for c in counts) + (", cleaned string" if with_text else "")
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    judged = map_batches(read, kernel, schema).withColumn("base_failed", base)
    return judged.withColumn("kept", ~F.col("base_failed") & (100 * F.col("n_removed_words") <= loss_percent * F.col("n_words")))
