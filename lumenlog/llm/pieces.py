"""A public SentencePiece model as a table of pieces, for the operators that score segmentations."""

from __future__ import annotations

import math


class Pieces:
    """Pieces of the model with unigram log-probabilities.

    The public model is a BPE one: its scores are ranks of merges. The unigram scores used here are Zipf's law over these ranks, p(r) in proportion to
    1 / (r + SHIFT); nothing is trained. A character that no piece covers is spelled in byte pieces, at BYTE each.
    """

    SHIFT = 3.0
    BYTE = -12.0

    def __init__(self, name: str):
        import public_tokenizers
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        ranked = {}
        self.byte = {}
        for i in range(model.vocab_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[3:-1], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                ranked[piece] = (i, max(0.0, -model.get_score(i)))
        # runs of blanks have no rank; the single one is held to be as rare as its id says
        ranked = {p: (i, r if r < 1e8 else float(i)) for p, (i, r) in ranked.items() if r < 1e8 or p == "▁"}
        total = math.log(sum(1 / (r + self.SHIFT) for _, r in ranked.values()))
        self.score = {p: -math.log(r + self.SHIFT) - total for p, (_, r) in ranked.items()}
        self.id = {p: i for p, (i, _) in ranked.items()}
        self.longest: dict[str, int] = {}
        for p in self.score:
            self.longest[p[:2]] = max(self.longest.get(p[:2], 0), len(p))
            self.longest[p[:1]] = max(self.longest.get(p[:1], 0), 1)
        #: Whether no piece reaches from one word into the next, so that words can be segmented apart.
        self.by_word = not any("▁" in p.lstrip("▁") for p in ranked)

    def spelled(self, char: str) -> list[int]:
        return [self.byte[b] for b in char.encode("utf-8")]


_held: dict[str, Pieces] = {}


def pieces(name: str) -> Pieces:
    """The worker's table for a model."""
    if name not in _held:
        _held[name] = Pieces(name)
    return _held[name]
