"""SentencePiece encoding and decoding for merge-type vocabularies.

A segment starts as single characters.  An agenda holds every adjacent pair whose join is a piece, best score
first, leftmost among equals; the head is merged, its neighbours form new pairs, and entries whose symbols have
changed since are skipped.  Characters without a piece fall back to bytes.

Texts are cut where no merge can ever happen, which the vocabulary proves when it is loaded: before a run of
space marks (if no piece holds a mark after another character), around characters that no longer piece holds, and
between letters and other characters (if no piece holds one next to the other).  Segments repeat, so each Python worker keeps a bounded memo of them.  New segments of each Arrow batch
are compared with the sentencepiece library, ids and decoded text, before they enter the memo; a difference
ends the job.  ``verify="texts"`` compares whole texts instead.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from .common import kept_by_worker, map_batches, record

MARK = "▁"
#: Segments in the younger half of a worker's memo; the older half holds as many.
MEMO_SEGMENTS = 120_000
#: Longer segments are encoded anew each time instead of filling the memo.
MEMO_CHARACTERS = 64

#: A key of the agenda is a place among the scores and, in the lower bits, the position of the pair's left symbol.
POSITION_BITS = 40
POSITION_MASK = (1 << POSITION_BITS) - 1

NORMAL, UNKNOWN, BYTE = 1, 2, 6


def default_model() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


class MergeVocabulary:
    """Pieces of a merge-type model without a normalisation table."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            model = sentencepiece_model_pb2.ModelProto.FromString(file.read())
        rules = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces:
            raise ValueError("only merge-type models with the identity normaliser are encoded here")
        self.path = path
        self.prefix = MARK if rules.add_dummy_prefix else ""
        self.pieces = [p.piece for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        #: What a piece decodes to.
        self.surface = [p.replace(MARK, " ") for p in self.pieces]
        places = {score: place for place, score in enumerate(sorted({p.score for p in model.pieces if p.type == NORMAL}, reverse=True))}
        #: Place of a piece among the scores, best first, as the upper part of its sort keys on the agenda.
        self.cost = {p.piece: places[p.score] << POSITION_BITS for p in model.pieces if p.type == NORMAL}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == UNKNOWN)
        merged = [p for p in self.ids if len(p) > 1]
        if any(MARK in p.lstrip(MARK) for p in merged):
            self.segments = None  # a merge could cross a space mark: texts stay whole
        else:
            lone = "".join(re.escape(c) for c in "\t\n\r" if not any(c in p for p in merged))
            words = self.word_pattern(merged, lone)
            self.segments = re.compile(f"[{lone}]|{MARK}*{words}|{MARK}+" if lone else f"{MARK}*{words}|{MARK}+")
        self.lone = "\n"

    @staticmethod
    def word_pattern(merged: list[str], lone: str) -> str:
        """What follows the marks of a segment: letters or other characters, if no piece joins the two kinds, else both."""
        pairs = {p[i : i + 2] for p in merged for i in range(len(p) - 1)}
        pairs = {pair for pair in pairs if pair[0] != MARK}
        letter = re.compile(r"[^\W\d_]").fullmatch
        # A character such as a raised 2 counts as a letter here but may be joined to signs: it goes to the others.
        odd = {c for pair in pairs for c, d in (pair, pair[::-1]) if letter(c) and not letter(d) and not c.isalpha()}
        is_letter = lambda c: bool(letter(c)) and c not in odd
        if any(is_letter(x) != is_letter(y) for x, y in pairs):
            return f"[^{MARK}{lone}]+"
        odd = re.escape("".join(sorted(odd)))
        return rf"(?:[^\W\d_{odd}]+|(?:[^\w{MARK}{lone}]|[\d_{odd}])+)"

    def cut(self, text: str) -> list[str]:
        """Segments of a text, marks in place of spaces; none for an empty text."""
        if not text:
            return []
        marked = self.prefix + text.replace(" ", MARK)
        return self.segments.findall(marked) if self.segments else [marked]

    def merge(self, segment: str) -> list[str]:
        """Pieces and left-over characters of a segment."""
        cost = self.cost.get
        symbols: list[str | None] = list(segment)
        n = len(symbols)
        agenda = [c + i for i in range(n - 1) if (c := cost(segment[i : i + 2])) is not None]
        if not agenda:
            return symbols
        heapify(agenda)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while agenda:
            left = (key := heappop(agenda)) & POSITION_MASK
            if (a := symbols[left]) is None or (right := after[left]) >= n or cost(pair := a + symbols[right]) != key - left:
                continue  # one side has been merged since
            symbols[left], symbols[right] = pair, None
            beyond = after[left] = after[right]
            if beyond < n:
                before[beyond] = left
                if (c := cost(pair + symbols[beyond])) is not None:
                    heappush(agenda, c + left)
            if (ahead := before[left]) >= 0 and (c := cost(symbols[ahead] + pair)) is not None:
                heappush(agenda, c + ahead)
        return [s for s in symbols if s is not None]

    def encode_segment(self, segment: str) -> list[int]:
        ids = []
        for symbol in self.merge(segment):
            found = self.ids.get(symbol)
            if found is not None:
                ids.append(found)
            elif self.bytes:
                ids += [self.bytes[b] for b in symbol.encode("utf-8")]
            else:
                ids.append(self.unknown)
        return ids

    def decode_ids(self, ids: list[int]) -> str:
        """Text of a run of ids, with the first space mark still in place."""
        if self.byte_of.keys().isdisjoint(ids):
            return "".join([self.surface[i] for i in ids])
        parts, held = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                parts.append(held.decode("utf-8", "replace"))
                held = bytearray()
            parts.append(self.surface[i])
        if held:
            parts.append(held.decode("utf-8", "replace"))
        return "".join(parts)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for a null or an empty one."""
        return [i for s in self.cut(text or "") for i in self.encode_segment(s)]

    def decode(self, ids: list[int]) -> str:
        text = self.decode_ids(ids)
        return text[1:] if self.prefix and text.startswith(" ") else text


class Differs(ValueError):
    """The library encodes or decodes otherwise."""


class Encoder:
    """A vocabulary with the worker's memo and the library to check against."""

    def __init__(self, path: str, text: bool = True):
        """The memo holds a segment's ids as decimal ``text`` joined by commas, else as bytes of 32-bit numbers."""
        self.text = text
        self.vocabulary = MergeVocabulary(path)
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.young: dict[str, str | bytes] = {}
        self.old: dict[str, str | bytes] = {}

    def same_as_library(self, segments: list[str], encoded: list[list[int]], decoded: list[str] | None = None) -> None:
        """Compare segments in one call: each is given so that the library puts the same mark before it."""
        vocabulary, bare = self.vocabulary, self.vocabulary.encode(self.vocabulary.lone)
        lone, marked = vocabulary.lone, bool(vocabulary.prefix)
        decoded = decoded or [vocabulary.decode_ids(ids) for ids in encoded]
        texts, heads = [], []
        for s in segments:
            if marked and s[0] == MARK:
                texts.append(s[1:].replace(MARK, " "))
                heads.append(0)
            else:
                texts.append(lone + s.replace(MARK, " "))
                heads.append(len(bare))
        theirs = self.library.encode(texts, num_threads=1)
        backs = self.library.decode(theirs, num_threads=1)
        for s, text, head, ids, own, their, back in zip(segments, texts, heads, encoded, decoded, theirs, backs):
            if text and (their[head:] != ids or back != (lone + own if head else own[1:])):
                raise Differs(f"segment {s!r}: {ids} here, {their[head:]} in the library")

    def encode_texts(self, texts: list[str], verify: bool) -> list[tuple[str | bytes, str]]:
        """For each text its ids, in the form the memo has, and its decoded text with the first mark's space."""
        vocabulary, young, old = self.vocabulary, self.young, self.old
        if len(young) > MEMO_SEGMENTS:
            self.old = old = young
            self.young = young = {}
        cut = [vocabulary.cut(t) for t in texts]
        here: dict[str, str | bytes] = {}
        new = []
        for s in set().union(*cut):
            held = young.get(s)
            if held is None:
                if (held := old.get(s)) is None:
                    new.append(s)
                    continue
                young[s] = held
            here[s] = held
        encoded = [vocabulary.encode_segment(s) for s in new]
        decoded = [vocabulary.decode_ids(ids) for ids in encoded]
        if verify:
            self.same_as_library(new, encoded, decoded)
        changed = {}
        for s, ids, back in zip(new, encoded, decoded):
            form = here[s] = ",".join(map(str, ids)) if self.text else array("i", ids).tobytes()
            if back != s.replace(MARK, " "):
                changed[s] = back
            elif len(s) <= MEMO_CHARACTERS:
                young[s] = form  # only what decodes to itself, so that the memo needs no decoded text
        find, joint = here.__getitem__, "," if self.text else b""
        made = []
        for segments in cut:
            if changed and not changed.keys().isdisjoint(segments):
                back = "".join([changed.get(s) or s.replace(MARK, " ") for s in segments])
            else:
                back = "".join(segments).replace(MARK, " ")
            made.append((joint.join(map(find, segments)), back))
        return made


def encoder(path: str, text: bool = True) -> Encoder:
    """The worker's encoder; one at a time, so that memos do not add up."""
    return kept_by_worker(("pieces", path, text), lambda: Encoder(path, text))


def blocks(texts: list[str], characters: int = 4_000_000):
    """Consecutive texts up to a number of characters, so that a batch of long texts stays small in memory."""
    block, held = [], 0
    for t in texts:
        block.append(t)
        held += len(t)
        if held >= characters:
            yield block
            block, held = [], 0
    if block:
        yield block


def encode_documents(
    docs: DataFrame, model: str | None = None, *, key: str = "doc_id", text: str = "text",
    outputs: tuple[str, ...] = ("ids",), verify: str | None = "segments",
) -> DataFrame:
    """One row per document: the key, n_tokens and what ``outputs`` names.

    ``ids`` array<int>, ``decoded`` string (decode of the ids), ``ids_sha256`` and ``decoded_sha256``: lower-case
    hex digests of the decimal ids joined by commas and of the decoded UTF-8 text.  A null text encodes like an
    empty one, to no ids.  Repeated rows and null keys give a row each; other columns are not read.
    ``model`` is a path that every executor has; by default the public vocabulary installed there.
    """
    types = {"ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}
    marked = bool(MergeVocabulary(model or default_model()).prefix)
    wants_text = verify == "texts" or "ids_sha256" in outputs

    def digest(text: str) -> str:
        return hashlib.sha256(text.encode("utf-8")).hexdigest()

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        held = encoder(model or default_model(), wants_text)
        rows: dict[str, list] = {name: [] for name in ("n_tokens", *outputs)}
        for texts in blocks([t or "" for t in batch.column(1).to_pylist()]):
            for t, (ids, decoded) in zip(texts, held.encode_texts(texts, verify == "segments")):
                if marked:
                    decoded = decoded.removeprefix(" ")
                if verify == "texts":
                    theirs = held.library.encode(t)
                    if ids != ",".join(map(str, theirs)) or decoded != held.library.decode(theirs):
                        raise Differs(f"a text of {len(t)} characters")
                rows["n_tokens"].append((ids.count(",") + bool(ids)) if wants_text else len(ids) // 4)
                made = {
                    "ids": lambda: array("i", map(int, ids.split(",") if ids else [])).tobytes() if wants_text else ids,
                    "decoded": lambda: decoded, "ids_sha256": lambda: digest(ids), "decoded_sha256": lambda: digest(decoded),
                }
                for name in outputs:
                    rows[name].append(made[name]())
        arrow = {name: pa.array(rows[name], pa.string()) for name in outputs if name != "ids"}
        if "ids" in outputs:
            ends = np.concatenate([[0], np.cumsum(rows["n_tokens"])]).astype(np.int32)
            arrow["ids"] = pa.ListArray.from_arrays(ends, np.frombuffer(b"".join(rows["ids"]), dtype=np.int32))
        return record(doc_id=batch.column(0), n_tokens=(rows["n_tokens"], pa.int64()), **{name: arrow[name] for name in outputs})

    read = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = read.schema["doc_id"].dataType.simpleString()
    return map_batches(read, kernel, f"doc_id {kind}, n_tokens bigint" + "".join(f", {name} {types[name]}" for name in outputs))


def decode_documents(encoded: DataFrame, model: str | None = None, *, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """The key and the text of every row's ids; a null list decodes to an empty text."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        vocabulary = encoder(model or default_model()).vocabulary
        return record(doc_id=batch.column(0), text=([vocabulary.decode(held or []) for held in batch.column(1).to_pylist()], pa.string()))

    read = encoded.select(F.col(key).alias("doc_id"), F.col(ids).alias("ids"))
    return map_batches(read, kernel, f"doc_id {read.schema['doc_id'].dataType.simpleString()}, text string")
