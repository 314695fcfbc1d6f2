"""Token counts under a sentence-piece vocabulary, by rank-synchronous array merging.

Texts are cut into pre-tokens (blanks and what follows up to the next blank), since no piece reaches
over the end of a word. The distinct pre-tokens of a batch are merged together as ragged arrays; the
surviving symbols of each are counted and added up by document. Characters outside the vocabulary
count as many tokens as they have bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tidemark.llm import merging, tokens

BLANK = "▁"


class Pieces:
    """The merge table of a vocabulary file; its size is that of the file, whatever the input."""

    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [i for i in range(m.get_piece_size())
                  if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        score = {m.id_to_piece(i): m.get_score(i) for i in normal}
        if any(BLANK in p.lstrip(BLANK) for p in score):
            raise ValueError("pieces of this vocabulary reach over the ends of words")
        if m.encode("a a", out_type=str) != [BLANK + "a", BLANK + "a"]:
            raise ValueError("a vocabulary that puts a blank before the text is needed")
        levels = {s: i for i, s in enumerate(sorted(set(score.values()), reverse=True))}
        symbol = {p: i for i, p in enumerate(dict.fromkeys([*score, *"".join(score)]))}
        rows = [(symbol[p[:k]], symbol[p[k:]], levels[s], symbol[p]) for p, s in score.items()
                for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol]
        self.pairs = merging.Pairs(*zip(*rows))
        n = len(symbol)
        self.of_char = np.full(0x110000, -1, np.int64)
        for p, i in symbol.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        self.of_char[32] = self.of_char[ord(BLANK)]
        # symbols n+1 to n+4: characters outside the vocabulary, by their bytes
        self.weight = np.concatenate([[1 if p in score else len(p.encode()) for p in symbol], np.arange(5)])
        code = np.arange(0x110000)
        size = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
        self.of_char = np.where(self.of_char < 0, n + size, self.of_char)

    def count(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Tokens of each text, whose bytes begin with the added blank."""
        n = len(raw)
        first = np.zeros(n + 1, bool)
        first[off] = True
        blank = raw == 32
        start = first[:n] | blank
        start[1:] &= first[1:n] | ~blank[:-1]
        s = np.flatnonzero(start)
        e = np.append(s[1:], n)
        up, down = tokens._powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
        h = tokens.mix(((total[e] - total[s]) * down[s]) ^ (e - s).astype(np.uint64))
        _, one, place = np.unique(h, return_index=True, return_inverse=True)
        s1, size = s[one], (e - s)[one]
        begin = np.concatenate([[0], np.cumsum(size)])
        flat = raw[np.repeat(s1 - begin[:-1], size) + np.arange(begin[-1])]
        lead = np.concatenate([[0], np.cumsum((flat & 0xC0) != 0x80)])
        code = np.frombuffer(flat.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        sym, o = merging.merge(self.of_char[code], lead[begin], self.pairs)
        each = np.add.reduceat(np.append(self.weight[sym], 0), o[:-1]) if len(o) > 1 else np.zeros(0, np.int64)
        row = np.searchsorted(off, s, "right") - 1
        return np.bincount(row, weights=each[place], minlength=len(off) - 1).astype(np.int64)


#: Bytes of text whose distinct pre-tokens are merged together.
BATCH = 4 << 20


def count_tokens(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """`docs` (doc_id, text) -> doc_id, n_bytes, n_tokens, over_limit, one row for each input row.
    Null and empty texts have no bytes and no tokens; a null doc_id stays null; other columns are
    ignored."""
    pieces = docs.sparkSession.sparkContext.broadcast(Pieces(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column(1).fill_null("")
            size = pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
            led = pc.binary_join_element_wise("", pc.replace_substring(text, BLANK, " "), " ")
            raw, off = tokens.parts(led)
            n = np.zeros(len(text), np.int64)
            for i, j in tokens.slices(off, BATCH):
                n[i:j] = pieces.value.count(raw[off[i]: off[j]], off[i: j + 1] - off[i])
            n[size == 0] = 0
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size), pa.array(n), pa.array(n > limit)],
                                             ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
