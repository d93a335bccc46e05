"""Media columns: payloads in JPEG images, and features read back from stored images."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm import jpeg
from tideline.llm.text import bounded_batches

#: Bytes of payload that are coded at once, and bytes of images that are decoded at once.
CHUNK, READ = 1 << 16, 1 << 19
#: Blocks across at most, by the 16-bit width of the format.
WIDEST = 8191


def encode_payloads(payloads: list[bytes], lengths: list[int]) -> list[bytes]:
    """An image for each payload: byte i of each 64 is the block's i-th quantised coefficient, the format's unit.

    ``lengths`` are the lengths before padding; they go into a comment.
    """
    blocks = [np.frombuffer(p, dtype=np.uint8).reshape(-1, 64) for p in payloads]
    across = [min(WIDEST, int(np.ceil(np.sqrt(len(b))))) for b in blocks]
    down = [-(-len(b) // a) for a, b in zip(across, blocks)]
    if max(down, default=0) > WIDEST:
        raise ValueError("a payload is larger than an image can hold")
    scans: list[list[bytes]] = [[] for _ in payloads]
    pieces = []  # (image, first block, blocks) of at most CHUNK bytes
    for i, (a, d) in enumerate(zip(across, down)):
        pieces += [(i, at, min(CHUNK // 64, a * d - at)) for at in range(0, a * d, CHUNK // 64)]
    for part in jpeg.chunks([64 * p[2] for p in pieces], CHUNK):
        own = pieces[part]
        grid = np.zeros((sum(n for _, _, n in own), 64), dtype=np.uint8)
        restart = np.concatenate([np.arange(at, at + n) for _, at, n in own])
        row = 0
        for i, at, n in own:
            held = blocks[i][at : at + n]
            grid[row : row + len(held)] = held
            row += n
        data, ends = jpeg.entropy_code(grid, restart)
        row = 0
        for i, _, n in own:
            scans[i].append(data[ends[row - 1] if row else 0 : ends[row + n - 1]].tobytes())
            row += n
    return [jpeg.image(8 * a, 8 * d, b"".join(s)[:-2], f"payload {n} {len(p)}".encode()) for a, d, s, n, p in zip(across, down, scans, lengths, payloads)]


def with_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, media): each whole text as the UTF-8 payload of a JPEG image.

    The payload is the text's bytes and zero bytes up to a positive multiple of
    64; a null text is empty. Equal texts give equal images. Other columns are
    ignored, repeated rows stay, and an empty table gives an empty result.
    """

    def run(batches):
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "").cast(pa.large_binary())
            sizes = pc.binary_length(texts).to_pylist()
            media: list[bytes] = []
            for part in jpeg.chunks(sizes, 8 * READ):
                raw = texts[part].to_pylist()
                padded = [x + bytes(-len(x) % 64 if x else 64) for x in raw]
                media += encode_payloads(padded, [len(x) for x in raw])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(media, pa.binary())], ["doc_id", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    return bounded_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).mapInArrow(run, f"doc_id {kind}, media binary")


def difference_hash(grey: np.ndarray) -> str:
    """64 bits: whether each of 8 x 8 places is lighter than its right neighbour, places spread evenly over the image."""
    rows = np.arange(8) * grey.shape[0] // 8
    columns = np.arange(9) * grey.shape[1] // 9
    small = grey[np.ix_(rows, columns)].astype(np.int64)
    return np.packbits(small[:, :-1] > small[:, 1:]).tobytes().hex()


def describe(images: list[bytes]) -> list[dict]:
    """Dimensions, thumbnail, hashes and payload of each stored image."""
    out = []
    for part in jpeg.chunks([len(x) for x in images], READ):
        frames = [jpeg.parse(x) for x in images[part]]
        for data, frame, blocks in zip(images[part], frames, jpeg.decode(frames)):
            grey = jpeg.thumbnail(frame, blocks)
            note = next((c.split() for c in frame.comments if c.startswith(b"payload ")), [b"", b"-1", b"0"])
            payload = blocks.astype(np.uint8).reshape(-1)[: int(note[2])].tobytes()
            out.append({"width": frame.width, "height": frame.height, "thumbnail": grey.tobytes(), "thumbnail_hash": difference_hash(grey), "n_bytes": int(note[1]), "payload": payload, "media": data})
    return out


def image_features(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Read stored baseline JPEG images back: dimensions, DC-only luminance thumbnail and hashes, and the payload's digests.

    Images that hold no payload (any baseline JPEG) have n_bytes -1 and an
    empty payload. Null or broken images give nulls, with the reason in ``error``.
    """

    def run(batches):
        names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "width", "height", "thumbnail", "thumbnail_hash", "feature", "error"]
        for batch in batches:
            data = batch.column(1).to_pylist()
            for part in jpeg.chunks([len(x or b"") for x in data], 8 * READ):
                rows = []
                own = data[part]
                try:
                    found = describe(own)
                except (ValueError, TypeError, KeyError, IndexError):
                    found = [_alone(x) for x in own]
                for x in found:
                    if "error" in x:
                        rows.append([None] * 11 + [x["error"]])
                        continue
                    p = x["payload"]
                    mark = f"{x['width']}x{x['height']}:{x['thumbnail_hash']}:{hashlib.sha1(x['thumbnail']).hexdigest()[:16]}"
                    rows.append([x["n_bytes"], len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(x["media"]), hashlib.sha256(x["media"]).hexdigest(), x["width"], x["height"], x["thumbnail"], x["thumbnail_hash"], mark, None])
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([batch.column(0)[part], *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], ["doc_id", *names])

    kind = media.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, width int, height int, thumbnail binary, thumbnail_hash string, feature string, error string"
    return bounded_batches(media.select(F.col(id_col).alias("doc_id"), F.col(media_col).alias("media"))).mapInArrow(run, schema)


def _alone(data: bytes | None) -> dict:
    if data is None:
        return {"error": "null"}
    try:
        return describe([data])[0]
    except (ValueError, KeyError, IndexError) as e:
        return {"error": str(e) or type(e).__name__}
