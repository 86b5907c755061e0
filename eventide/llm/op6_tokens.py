"""Token counts under a unigram piece model, by a trie with shared dynamic programmes.

A text's tokens are those of its best segmentation: the one whose pieces have
the greatest sum of scores, with fewer pieces on ties. Texts are cut at white
space (U+0020, U+0009 to U+000D) and every word is marked with the piece
model's word mark in front. The distinct words of a chunk are sorted, which
walks their trie depth first: the best score up to each character is kept on a
stack, so a prefix that several words share is computed once, and a word's
count is stored where it ends. A character that is no piece costs a token for
each of its UTF-8 bytes and the score of ``unknown`` for each.

Null texts are empty and have no tokens. Repeated rows each give a row; other
columns are ignored. What a task holds is the vocabulary and one chunk.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .texts import map_texts

MARK = "▁"


class WordTrie:
    """Counts of words by forward scores along their trie."""

    def __init__(self, scores: dict[str, float], unknown: float | None = None) -> None:
        self.scores = scores
        self.unknown = min(scores.values(), default=0.0) - 10.0 if unknown is None else unknown
        sizes: dict[str, set[int]] = {}
        for piece in scores:
            sizes.setdefault(piece[-1], set()).add(len(piece))
        #: By last character: the sizes of the pieces that end in it.
        self.sizes = {c: sorted(x) for c, x in sizes.items()}

    def count(self, words: list[str]) -> list[int]:
        """Tokens of each word; ``words`` must be sorted."""
        get, sizes, unknown = self.scores.get, self.sizes, self.unknown
        best, tokens = [0.0], [0]
        before = ""
        out = []
        for word in words:
            n = len(word)
            d, most = 0, min(n, len(before), len(best) - 1)
            while d < most and word[d] == before[d]:
                d += 1
            del best[d + 1 :], tokens[d + 1 :]
            for end in range(d + 1, n + 1):
                c = word[end - 1]
                k = len(c.encode())
                high, few = best[end - 1] + unknown * k, tokens[end - 1] + k
                for size in sizes.get(c, ()):
                    if size > end:
                        break
                    s = get(word[end - size : end])
                    if s is not None:
                        s += best[end - size]
                        t = tokens[end - size] + 1
                        if s > high or s == high and t < few:
                            high, few = s, t
                best.append(high)
                tokens.append(few)
            out.append(tokens[n])
            before = word
        return out


class _Codes(dict):
    def __missing__(self, key) -> int:
        self[key] = code = len(self)
        return code


def count_tokens(docs: DataFrame, scores: dict[str, float], id_col: str = "doc_id", text_col: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """n_words and n_tokens of each row."""
    holder: list[WordTrie] = []

    def run(texts: list[bytes]) -> dict:
        if not holder:
            holder.append(WordTrie(scores))
        codes = _Codes()
        split = [t.split() for t in texts]
        n = np.array([len(x) for x in split], dtype=np.int64)
        flat = np.fromiter(map(codes.__getitem__, chain.from_iterable(split)), dtype=np.int64, count=n.sum())
        words = [MARK + w.decode("utf-8", "replace") for w in codes]
        order = sorted(range(len(words)), key=words.__getitem__)
        counts = np.zeros(len(words) + 1, dtype=np.int64)
        counts[order] = holder[0].count([words[i] for i in order])
        upto = np.concatenate([[0], np.cumsum(counts[flat])])
        ends = np.cumsum(n)
        return {"n_words": pa.array(n), "n_tokens": pa.array(upto[ends] - upto[ends - n])}

    return map_texts(docs, keep or {id_col: F.col(id_col)}, text_col, "n_words long, n_tokens long", run, chunk_bytes=12 << 20)


def load_scores(path: str) -> dict[str, float]:
    """Piece to score, from a sentencepiece model; control, unknown and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    return {model.id_to_piece(i): model.get_score(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}


def default_scores() -> dict[str, float]:
    import public_tokenizers

    return load_scores(public_tokenizers.path("piece_bpe_32k.model"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_scores())
