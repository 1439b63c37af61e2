"""BPE encoding and decoding with a public vocabulary file.

Encoding splits off the special tokens, normalises (NFC, white space to one space, lower case), cuts the text into
words, writes each word's bytes as printable characters, marks its last one with the word-end suffix and merges.
Merging keeps the symbols in a doubly linked list and the possible merges in a priority queue of (rank, position);
an entry whose pair has changed since it was queued is stale and skipped. Decoding looks each id's string up and
joins the strings, by one space where the vocabulary has no decoder of its own.

A worker remembers the ids of words it has merged, at most ``REMEMBERED`` of them, and starts anew beyond; this
bounds its memory and changes no result.

Defined cases: null text is the empty text, with no ids; ids beyond the vocabulary decode to nothing; any text is
encoded whole, in batches cut by size so that very long texts need no more than their own memory; repeated rows and
nulls in other columns pass through; an empty table gives an empty result; a column of docs whose name clashes with
an output column is replaced by it.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, tidy, worker_memory

REMEMBERED = 1 << 18
#: Characters a batch of results may hold before it is sent on.
BATCH_CHARS = 1 << 21


def printable_bytes() -> list[str]:
    """Each byte's character: itself where it prints, else the next one from 256."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in own else next(spare)) for b in range(256)]


class Bpe:
    """A BPE vocabulary with word ends, read from a tokenizer's JSON text."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        merges = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"])
        self.merges = {(self.ids[a], self.ids[b]): (rank, self.ids[a + b]) for rank, (a, b) in enumerate(merges)}
        specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.specials = specials
        self.special = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        names = {i: s for s, i in self.ids.items()} | {i: s for s, i in specials.items()}
        self.strings = [names.get(i, "") for i in range(max(names) + 1)]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        # Only Unicode's own white space counts here, without the separators U+001C to U+001F.
        blank = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
        self.words = regex.compile(split["pattern"]["Regex"].replace(r"\s", blank))
        self.shown = printable_bytes()
        self.known: dict[str, array] = {}

    def merge(self, symbols: list[int]) -> list[int]:
        """Apply the merges to a list of ids, lowest rank first and leftmost first within a rank."""
        last = len(symbols) - 1
        before, after = list(range(-1, last)), list(range(1, last + 2))
        queue = [(m[0], k, m[1]) for k in range(last) if (m := self.merges.get((symbols[k], symbols[k + 1])))]
        heapq.heapify(queue)
        while queue:
            _, k, made = heapq.heappop(queue)
            right = after[k]
            if symbols[k] < 0 or right > last:
                continue
            now = self.merges.get((symbols[k], symbols[right]))
            if now is None or now[1] != made:
                continue  # stale: one of the pair has been merged since
            symbols[k], symbols[right] = made, -1
            after[k] = after[right]
            if after[k] <= last:
                before[after[k]] = k
                if m := self.merges.get((made, symbols[after[k]])):
                    heapq.heappush(queue, (m[0], k, m[1]))
            if (left := before[k]) >= 0 and (m := self.merges.get((symbols[left], made))):
                heapq.heappush(queue, (m[0], left, m[1]))
        return [s for s in symbols if s >= 0]

    def word(self, word: str) -> array:
        chars = [self.shown[b] for b in word.encode()]
        chars[-1] += self.suffix
        return array("i", self.merge([self.ids[c] for c in chars if c in self.ids]))

    def _plain(self, text: str) -> Iterator[array]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        # Lower case goes by character: a final sigma is no other letter here.
        text = text.lower() if text.isascii() or "Σ" not in text else "".join(map(str.lower, text))
        known = self.known
        for word in self.words.findall(text):
            ids = known.get(word)
            if ids is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                ids = known[word] = self.word(word)
            yield ids

    def encode(self, text: str) -> array:
        if self.special is None or not any(s in text for s in self.specials):
            return array("i", chain.from_iterable(self._plain(text)))
        out, at = array("i"), 0
        for m in self.special.finditer(text):
            out.extend(chain.from_iterable(self._plain(text[at : m.start()])))
            out.append(self.specials[m.group()])
            at = m.end()
        out.extend(chain.from_iterable(self._plain(text[at:])))
        return out

    def decode(self, ids: array) -> str:
        strings, n = self.strings, len(self.strings)
        return " ".join([strings[i] for i in ids if 0 <= i < n])


def encode(docs: DataFrame, vocabulary: str, text_col: str = "text", carry: list[str] | None = None, decoded: bool = False) -> DataFrame:
    """The carried columns (all by default) with ``ids``, and ``decoded``, decoded from the ids, if asked for.

    vocabulary: the path of a tokenizer's JSON file, read by the driver; some MB, of fixed size, go to the workers.
    """
    with open(vocabulary, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    added = ["ids", *["decoded"] * decoded]
    kept = [c for c in (docs.columns if carry is None else carry) if c not in added]
    row = F.struct(*[F.col(f"`{c}`") for c in kept] or [F.lit(0).alias("none")]).alias("row")
    source = docs.select(row, text_of(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = shared.value
        bpe = worker_memory(f"bpe {crc32(text.encode())} {len(text)}", lambda: Bpe(text))
        for b in batches:
            at, texts = 0, b.column("text")
            while at < len(b):
                start, chars, flat, ends, back = at, 0, array("i"), array("i", [0]), []
                while at < len(b) and chars < BATCH_CHARS:
                    given = texts[at].as_py()
                    ids = bpe.encode(given)
                    flat.extend(ids)
                    ends.append(len(flat))
                    if decoded:
                        back.append(bpe.decode(ids))
                    chars += len(given) + 1
                    at += 1
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
                cols = [b.column("row").slice(start, at - start), lists, *[pa.array(back, pa.string())] * decoded]
                yield pa.RecordBatch.from_arrays(cols, names=["row", *added])

    schema = f"row {source.schema['row'].dataType.simpleString()}, ids array<int>" + ", decoded string" * decoded
    done = source.mapInArrow(tidy(run, keeps=True), schema)
    return done.select(*[F.col("row")[c].alias(c) for c in kept], *added)
