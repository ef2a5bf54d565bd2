"""Token counts under a unigram tokenizer, by dynamic programming that shares prefixes.

A pre-token is "\\u2581" and a word `[^\\x20\\x09-\\x0D]+`. Its segmentation is the one with the largest sum of piece
scores (ties: the longest last piece). A character that no piece covers takes as many tokens as it has bytes, at
PENALTY below the smallest score.

The distinct pre-tokens of a batch are put in order, which walks their trie depth first: the best score and the token
count up to each place are worked out once for each shared prefix and stay in place for the words that share it. Counts
of whole words are kept in the task for later batches (at most KEPT words at once), and a text's count is the sum
over its words. Nothing is shuffled; the vocabulary is broadcast and its size is that of its file.

Rows: a null text has no tokens; equal rows get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame

from fleetpulse.llm.tables import columns

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
KEPT = 500_000
PENALTY = 10.0
SPACE = "▁"


def load_vocabulary(path: str = VOCABULARY) -> dict[str, float]:
    """Pieces and scores of a tokenizer file. The file ranks its pieces; the score of rank r is that of Zipf's law."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    ids.sort(key=lambda i: -model.get_score(i))
    total = log(sum(1 / (r + 1) for r in range(len(ids))))
    return {model.id_to_piece(i): -log(r + 1) - total for r, i in enumerate(ids)}


def trie_counts(words: Iterable[str], scores: dict[str, float]) -> dict[str, int]:
    """The number of tokens of each distinct word."""
    longest = max(map(len, scores), default=1)
    unknown = min(scores.values(), default=0.0) - PENALTY
    best, tokens, path, out = [0.0], [0], "", {}
    get = scores.get
    for word in sorted(words):
        own = SPACE + word
        same, most = 0, min(len(own), len(path))
        while same < most and own[same] == path[same]:
            same += 1
        del best[same + 1 :], tokens[same + 1 :]
        for end in range(same + 1, len(own) + 1):
            top, count = None, 0
            for start in range(max(0, end - longest), end):
                piece = get(own[start:end])
                if piece is not None and (top is None or best[start] + piece > top):
                    top, count = best[start] + piece, tokens[start] + 1
            if get(own[end - 1]) is None:
                lone = best[end - 1] + unknown
                if top is None or lone > top:
                    top, count = lone, tokens[end - 1] + len(own[end - 1].encode("utf-8", "surrogatepass"))
            best.append(top)
            tokens.append(count)
        path = own
        out[word] = tokens[-1]
    return out


def count_tokens(docs: DataFrame, scores: dict[str, float]) -> DataFrame:
    """doc_id, n_words and n_tokens of each whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(scores)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for at in range(0, len(texts), 256):
                split = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts[at : at + 256]]
                fresh = {w for words in split for w in words if w not in known}
                counts = trie_counts([w.decode("utf-8", "surrogatepass") for w in fresh], sent.value)
                if len(known) + len(counts) > KEPT:
                    known = {}
                    fresh = {w for words in split for w in words}
                    counts = trie_counts([w.decode("utf-8", "surrogatepass") for w in fresh], sent.value)
                known.update((w.encode("utf-8", "surrogatepass"), n) for w, n in counts.items())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(at, 256),
                        pa.array([len(words) for words in split], pa.int64()),
                        pa.array([sum(map(known.__getitem__, words)) for words in split], pa.int64()),
                    ],
                    names=["doc_id", "n_words", "n_tokens"],
                )

    return columns(docs, doc_id="long", text="string").mapInArrow(work, "doc_id long, n_words long, n_tokens long")
