"""Token counts by trie-shared dynamic programming (operator 10).

The tokens of a text are those of its pre-tokens' likeliest segmentations under a unigram model of pieces. The distinct
pre-tokens of a batch are the leaves of a trie. It is walked depth first, which is the order of the sorted pre-tokens, and the
forward pass (best score and its number of tokens, up to each character) is done once for each node: a pre-token starts from
what it shares with the one before it. The counts at the terminal nodes serve all occurrences.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame

from finstrata.llm.common import rows_as, texts

SCHEMA = "doc_id long, n_chars long, n_pretokens long, n_tokens long, log_prob double"
START = "▁"
#: Bytes of text whose pre-tokens are inserted in one trie.
TRIE_BYTES = 4_000_000


def pieces(model_file: str) -> dict[str, float]:
    """Log probabilities of a vocabulary's pieces, by Zipf's law from their ranks; control and byte pieces are left out."""
    import sentencepiece

    vocabulary = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ranked = [vocabulary.id_to_piece(i) for i in range(vocabulary.get_piece_size()) if not (vocabulary.is_control(i) or vocabulary.is_unknown(i) or vocabulary.is_byte(i))]
    total = sum(1 / (rank + 1) for rank in range(len(ranked)))
    return {piece: -math.log((rank + 1) * total) for rank, piece in enumerate(ranked)}


class Counts(dict):
    """pre-token (UTF-8) -> (tokens, log probability) of its likeliest segmentation; of equal ones, the shortest.

    A character that is no piece is written as its UTF-8 bytes, each of them a token less likely than any piece.
    """

    def __init__(self, scores: dict[str, float], most: int = 500_000):
        self.scores, self.most = scores, most
        self.longest, self.byte = max(map(len, scores)), min(scores.values()) - 2

    def insert(self, distinct: set[bytes]) -> None:
        """Adds the pre-tokens that are not there yet, in one walk over their trie."""
        new = sorted((START + word.decode("utf-8", "replace"), word) for word in distinct if word not in self)
        if len(self) + len(new) > self.most:
            self.clear()
            new = sorted((START + word.decode("utf-8", "replace"), word) for word in distinct)
        get, longest, before = self.scores.get, self.longest, ""
        best, tokens = [0.0], [0]  # by depth, of the path from the root
        for text, word in new:
            shared, most = 0, min(len(text), len(before))
            while shared < most and text[shared] == before[shared]:
                shared += 1
            del best[shared + 1 :], tokens[shared + 1 :]
            for end in range(shared + 1, len(text) + 1):
                size = len(text[end - 1].encode("utf-8", "replace"))
                score, count = best[end - 1] + size * self.byte, tokens[end - 1] + size
                for start in range(max(0, end - longest), end):
                    if (own := get(text[start:end])) is not None:
                        s, c = best[start] + own, tokens[start] + 1
                        if s > score or s == score and c < count:
                            score, count = s, c
                best.append(score)
                tokens.append(count)
            before = text
            self[word] = (tokens[-1], best[-1])


def token_counts(docs: DataFrame, model_file: str | None = None, scores: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_chars, n_pretokens, n_tokens and the segmentations' log probability.

    ``scores`` has the pieces' log probabilities; without it, they follow from the ranks in the vocabulary of ``model_file``. ``docs`` may
    be any number of texts, ``scores`` is a vocabulary and goes to each task.

    Pre-tokens are the runs between ASCII white space, each with a start mark. A null or empty text has none, and 0 tokens.
    Repeated rows and null ids stay as they are; other columns are not read. An empty table gives no rows.
    """
    schema = rows_as(SCHEMA)

    def counted(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counts = Counts(pieces(model_file) if scores is None else scores)

        def out(rows: list[tuple[int | None, int, list[bytes]]]):
            counts.insert({w for _, _, words in rows for w in words})
            ids, sizes, found = [r[0] for r in rows], [r[1] for r in rows], [[counts[w] for w in r[2]] for r in rows]
            arrays = [ids, sizes, list(map(len, found)), [sum(n for n, _ in x) for x in found], [math.fsum(p for _, p in x) for x in found]]
            return pa.RecordBatch.from_arrays([pa.array(a, f.type) for a, f in zip(arrays, schema, strict=True)], schema=schema)

        for batch in batches:
            rows, held = [], 0
            for doc_id, body in zip(batch.column("doc_id").to_pylist(), batch.column("body"), strict=True):
                text = body.as_py()
                rows.append((doc_id, len(text.decode("utf-8", "replace")), text.split()))
                held += len(text)
                if held > TRIE_BYTES:
                    yield out(rows)
                    rows, held = [], 0
            if rows:
                yield out(rows)

    return texts(docs, id_col, text_col).mapInArrow(counted, SCHEMA)
