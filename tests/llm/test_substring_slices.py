import numpy as np
import pyarrow as pa
import zstandard

from matchloom.llm import substring

RUN = pa.list_(pa.struct([("piece", pa.int64()), ("start", pa.int32()), ("windows", pa.int32())]))


def test_edges_of_many_documents_are_read_at_once(monkeypatch):
    """Documents of a slice share one pass over their words and one batch; places that are another row's are left out."""
    made, real = [], substring.Words
    monkeypatch.setattr(substring, "Words", lambda texts, seed: made.append(len(texts)) or real(texts, seed))
    texts = [" ".join(f"w{i * 7 + k}" for k in range(20 + i)).encode() for i in range(30)]
    pieces, want = [], []
    for i, text in enumerate(texts):
        words = real([text], 0)
        piece = int(words.pieces(np.array([2]), np.array([15]))[0])
        # The second place names words that are not there, the third ends behind the text.
        pieces.append([{"piece": piece, "start": 2, "windows": 3}, {"piece": piece, "start": 3, "windows": 3}, {"piece": piece, "start": 15 + i, "windows": 3}])
        hashes = substring.gram_hashes(words.hashes, 13).view(np.int64)
        want += [(int(hashes[2 + k]), piece, k, 100 + i, 2 + k) for k in range(3)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(100, 130)), pa.array([zstandard.compress(t) for t in texts]), pa.array(pieces, RUN)], names=["doc_id", "packed", "wanted"]
    )
    out = list(substring._edges(13, 0)([batch]))
    assert made == [30] and len(out) == 1
    assert [tuple(r.values()) for r in out[0].to_pylist()] == want
