"""A subword vocabulary as a trie, and forward and backward sums over all segmentations of words, in log space.

The pieces are those of an existing vocabulary file; its rank order gives every piece a starting weight by Zipf's law.
Every single byte is a piece too, so any string has a segmentation.  Words carry a mark in front, as in the file.
"""

from __future__ import annotations

import numpy as np

MARK = "▁".encode()
VOCABULARY = "piece_bpe_32k.model"
#: Cells of the work arrays that are filled at once.
CELLS = 200_000


def existing_vocabulary(name: str = VOCABULARY) -> dict[bytes, float]:
    """piece -> log10 weight; the weights and that of the end of a word sum to one.

    The file's scores are minus the piece's rank; ranks become weights by Zipf's law."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    rank = {bytes([b]): float(model.get_piece_size()) for b in range(256)}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            rank[model.id_to_piece(i).encode()] = -model.get_score(i)
    rank[b""] = 1.0  # the end of a word
    weight = {p: 1 / (r + 3) for p, r in rank.items()}
    total = sum(weight.values())
    return {p: float(np.log10(w / total)) for p, w in sorted(weight.items())}


class Lattice:
    """Pieces in a trie; state 0 is dead, 1 the root; ``weight`` is in natural logarithms, by piece number."""

    def __init__(self, pieces: list[bytes]) -> None:
        self.pieces = pieces  # sorted; pieces[0] is the end of a word
        states: dict[tuple[int, int], int] = {}
        ends = {}
        for number, piece in enumerate(pieces):
            at = 1
            for byte in piece:
                at = states.setdefault((at, byte), len(states) + 2)
            ends[at] = number
        self.next = np.zeros((len(states) + 2, 256), np.int32)
        for (at, byte), to in states.items():
            self.next[at, byte] = to
        self.piece_at = np.full(len(states) + 2, -1, np.int32)
        for at, number in ends.items():
            if at != 1:
                self.piece_at[at] = number

    def blocks(self, words: list[bytes]):
        """(places of the words, matrix of their bytes, lengths), longest first, in bounded blocks."""
        order = sorted(range(len(words)), key=lambda i: -len(words[i]))
        at = 0
        while at < len(order):
            width = max(1, len(words[order[at]]))
            part = order[at : at + max(1, CELLS // width)]
            lengths = np.array([len(words[i]) for i in part])
            chars = np.frombuffer(b"".join(words[i].ljust(width, b"\0") for i in part), np.uint8).reshape(len(part), width)
            yield np.array(part), chars, lengths
            at += len(part)

    def matches(self, chars: np.ndarray, lengths: np.ndarray, start: int):
        """(length, rows, piece numbers) of all pieces that begin at ``start``."""
        rows = np.flatnonzero(lengths > start)
        state = np.ones(len(rows), np.int32)
        for k in range(1, chars.shape[1] - start + 1):
            alive = lengths[rows] >= start + k
            if not alive.all():
                rows, state = rows[alive], state[alive]
            state = self.next[state, chars[rows, start + k - 1]]
            alive = state > 0
            rows, state = rows[alive], state[alive]
            if not len(rows):
                return
            piece = self.piece_at[state]
            hit = piece >= 0
            if hit.any():
                yield k, rows[hit], piece[hit]

    def forward(self, chars: np.ndarray, lengths: np.ndarray, weight: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Log sums of all segmentations up to each place."""
        alpha = np.full((len(chars), chars.shape[1] + 1), -np.inf)
        alpha[:, 0] = 0
        for start in range(chars.shape[1]):
            found = list(self.matches(chars, lengths, start))
            if keep is not None:
                keep.append(found)
            for k, rows, piece in found:
                alpha[rows, start + k] = np.logaddexp(alpha[rows, start + k], alpha[rows, start] + weight[piece])
        return alpha

    def log10(self, words: list[bytes], weight: np.ndarray) -> np.ndarray:
        """log10 probability of each word, its end included, over all segmentations."""
        out = np.empty(len(words))
        for part, chars, lengths in self.blocks(words):
            alpha = self.forward(chars, lengths, weight)
            out[part] = (alpha[np.arange(len(part)), lengths] + weight[0]) / np.log(10)
        return out

    def expected(self, words: list[bytes], weight: np.ndarray, often: np.ndarray | None = None) -> np.ndarray:
        """Sum over the words, each as ``often`` as it says, of the expected number of times that a piece is used."""
        counts = np.zeros(len(self.pieces))
        often = np.ones(len(words)) if often is None else often
        for part, chars, lengths in self.blocks(words):
            kept: list = []
            times = often[part]
            alpha = self.forward(chars, lengths, weight, kept)
            own = np.arange(len(chars))
            total = alpha[own, lengths]
            beta = np.full(alpha.shape, -np.inf)
            beta[own, lengths] = 0
            for start in range(chars.shape[1] - 1, -1, -1):
                for k, rows, piece in kept[start]:
                    through = weight[piece] + beta[rows, start + k]
                    beta[rows, start] = np.logaddexp(beta[rows, start], through)
                    counts += np.bincount(piece, times[rows] * np.exp(alpha[rows, start] + through - total[rows]), len(counts))
            counts[0] += times.sum()
        return counts
