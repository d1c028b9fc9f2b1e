"""Telephony audio columns: mu-law and A-law by lookup table, IMA ADPCM by blocks, resampled PCM.

A media column holds WAV files of telephone audio. A payload of whole 64-byte blocks
is stored byte for byte as mu-law samples, as A-law samples or as ADPCM blocks, which
of them its checksum says, so that all three stand in one column. Read back, mu-law
and A-law are expanded by lookup tables; ADPCM decoding goes through the samples of a
block in order, for all blocks of many files at once. What comes out is resampled and
kept as a WAV of 16-bit PCM beside the measures taken from it.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gazetta.llm.common import lean, table, written

#: Fixed values of the formats: WAV codec numbers, telephone sample rate, and the
#: ADPCM tables of steps and of index changes by the three low bits of a code.
PCM, ALAW, MULAW, ADPCM = 1, 6, 7, 17
RATE = 8000
# fmt: off
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132,
    7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767], np.int32)
# fmt: on
INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)
#: Bytes of an ADPCM block, rate of the stored PCM, bytes of payload worked on at a time.
BLOCK, STORED_RATE, CHUNK = 64, 16_000, 1 << 20


def _mulaw() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def _alaw() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    low, exponent = (code & 15) << 4, code >> 4 & 7
    size = np.where(exponent, low + 264 << np.maximum(exponent - 1, 0), low + 8)
    return np.where(code & 128, size, -size).astype(np.int16)


TABLES = {MULAW: _mulaw(), ALAW: _alaw()}


def wav(codec: int, data: bytes, rate: int = RATE, align: int | None = None) -> bytes:
    """A WAV file of one channel; align: bytes of a block."""
    align = align or {PCM: 2, ADPCM: BLOCK}.get(codec, 1)
    bits, block, extra = {PCM: 16, ADPCM: 4}.get(codec, 8), 1, b""
    if codec == ADPCM:
        block = 2 * align - 7  # samples of a block
        extra = struct.pack("<HH", 2, block)
    elif codec != PCM:
        extra = struct.pack("<H", 0)
    form = struct.pack("<HHIIHH", codec, 1, rate, rate * align // block, align, bits) + extra
    fact = b"" if codec == PCM else b"fact" + struct.pack("<II", 4, len(data) // align * block)
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + fact + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(media: bytes) -> tuple[int, int, int, bytes]:
    """Codec, rate, block alignment and data of a WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form, data = 12, None, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIHH", media, at + 8)
        elif name == b"data":
            data = media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    if form is None or data is None:
        raise ValueError("a WAV file without format or data")
    return form[0], form[2], form[4], data


def adpcm(blocks: np.ndarray) -> np.ndarray:
    """Samples of IMA ADPCM blocks of one channel: rows of bytes in, rows of 16-bit samples out.

    A block has a first sample of 16 bits, a step index (over 88 counts as 88), a
    byte of no meaning, and two codes in each further byte, the low one first.
    """
    n = len(blocks)
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), 88)
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((2 * len(codes) + 1, n), np.int16)
    out[0] = value
    for k in range(2 * len(codes)):
        code = (codes[k >> 1] >> 4 * (k & 1)) & np.uint8(15)
        step, low = STEPS[index], (code & 7).astype(np.int32)
        change = (step >> 3) + np.where(low & 4, step, 0) + np.where(low & 2, step >> 1, 0) + np.where(low & 1, step >> 2, 0)
        value += np.where(code & 8, -change, change)
        np.clip(value, -32768, 32767, out=value)
        index += INDEX[low]
        np.clip(index, 0, 88, out=index)
        out[k + 1] = value
    return out.T


def decode(media: bytes) -> tuple[int, np.ndarray]:
    """Rate and 16-bit samples of a WAV file in PCM, mu-law, A-law or ADPCM."""
    codec, rate, align, data = read_wav(media)
    if codec == PCM:
        return rate, np.frombuffer(data, "<i2")
    if codec == ADPCM:
        return rate, adpcm(np.frombuffer(data[: len(data) // align * align], np.uint8).reshape(-1, align)).reshape(-1)
    return rate, TABLES[codec][np.frombuffer(data, np.uint8)]


def resample(samples: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Samples at another rate, by linear interpolation in integers, rounded down; the last sample is held."""
    if not len(samples) or rate == to:
        return samples
    g = math.gcd(rate, to)
    up, down = to // g, rate // g
    n = len(samples) * up // down
    if down == 1 and up == 2:
        x = samples.astype(np.int32)
        out = np.empty(n, np.int16)
        out[::2] = samples
        out[1::2] = (x + np.r_[x[1:], x[-1:]]) >> 1
        return out
    place = np.arange(n, dtype=np.int64) * down
    at, part = place // up, place % up
    x = samples.astype(np.int64)
    return ((x[at] * (up - part) + x[np.minimum(at + 1, len(x) - 1)] * part) // up).astype(np.int16)


def payload(text: str | None) -> bytes:
    """UTF-8 bytes of a text, with zeros up to a positive multiple of 64."""
    raw = (text or "").encode()
    return raw + b"\0" * (max(BLOCK, -(-len(raw) // BLOCK) * BLOCK) - len(raw))


#: Codecs of stored payloads by the remainder of their checksum, and their names.
CODECS = (MULAW, ALAW, ADPCM)
NAMES = {MULAW: "mulaw", ALAW: "alaw", ADPCM: "adpcm"}


def medium(text: str | None) -> bytes:
    """The stored form of a text's payload."""
    data = payload(text)
    return wav(CODECS[zlib.crc32(data) % len(CODECS)], data)


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (a WAV of the payload) of each row of docs (doc_id, text).

    Null and empty texts give 64 zero bytes. Repeated rows give equal media, an
    empty table no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _chunks([x.as_buffer().size if x.is_valid else 0 for x in batch.column(1)]):
                some = batch.slice(part.start, part.stop - part.start)
                texts = some.column(1).to_pylist()
                size = [len((t or "").encode()) for t in texts]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(size, pa.int64()), pa.array(map(medium, texts), pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(lean(run), "doc_id long, n_bytes long, media binary")


def _chunks(sizes: list[int]) -> Iterator[slice]:
    start = total = 0
    for i, n in enumerate(sizes):
        total += n
        if total >= CHUNK or i + 1 == len(sizes):
            yield slice(start, i + 1)
            start, total = i + 1, 0


def _by_file(samples: np.ndarray, edge: np.ndarray) -> list[tuple[int, int]]:
    """Root mean square and zero crossings of each file; edge: where files start, and the end."""
    power = np.add.reduceat(np.square(samples, dtype=np.int64), edge[:-1])
    turn = np.zeros(len(samples), np.int64)
    turn[1:] = (samples[1:] < 0) != (samples[:-1] < 0)
    turn[edge[:-1]] = 0
    return [(math.isqrt(int(p) // n), int(z)) for p, n, z in zip(power, np.diff(edge).tolist(), np.add.reduceat(turn, edge[:-1]), strict=True)]


def _decoded(read: list[tuple[int, int, int, bytes]]) -> list[tuple[np.ndarray, int, int]]:
    """16-bit samples, root mean square and zero crossings of files as read_wav gives them, all of one codec and block size at once."""
    out: list = [None] * len(read)
    kinds: dict[tuple[int, int], list[int]] = {}
    for i, (codec, _, align, _) in enumerate(read):
        kinds.setdefault((codec, align), []).append(i)
    for (codec, align), rows in kinds.items():
        data = [read[i][3] for i in rows]
        raw, edge = np.frombuffer(b"".join(data), np.uint8), np.r_[0, np.cumsum([len(d) for d in data])]
        if codec == ADPCM:
            blocks = adpcm(raw.reshape(-1, align))
            samples, edge = blocks.reshape(-1), edge // align * blocks.shape[1]
        else:
            samples = TABLES[codec][raw]
        for i, a, b, told in zip(rows, edge[:-1], edge[1:], _by_file(samples, edge), strict=True):
            out[i] = samples[a:b], *told
    return out


def _told(medias: list[bytes]) -> list[tuple]:
    """What is told of the files of one chunk, from their stored bytes."""
    read = [read_wav(m) for m in medias]
    out = []
    for m, (codec, rate, _, data), (samples, power, turns) in zip(medias, read, _decoded(read), strict=True):
        pcm = wav(PCM, resample(samples, rate, STORED_RATE).astype("<i2").tobytes(), STORED_RATE)
        out.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-BLOCK:]), len(m), hashlib.sha256(m).hexdigest(), f"{NAMES[codec]}:{power}:{turns}", len(pcm), hashlib.sha256(pcm).hexdigest(), pcm))
    return out


_TOLD = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm_bytes long, pcm_sha256 string, pcm binary"


def read_back(media: DataFrame) -> DataFrame:
    """Payload, feature (codec:root mean square:zero crossings) and resampled PCM as a WAV of each row of media (doc_id, n_bytes, media of whole 64-byte blocks)."""
    columns = [x.split() for x in _TOLD.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _chunks([x.as_buffer().size for x in batch.column(2)]):
                some = batch.slice(part.start, part.stop - part.start)
                rows = _told(some.column(2).to_pylist())
                told = [pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(columns)]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), *told], names=["doc_id", "n_bytes", *(name for name, _ in columns)])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(lean(run), f"doc_id long, n_bytes long, {_TOLD}")


def op2_media_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media are written to the shared folder and read from there; the PCM is a column of the result."""
    return read_back(written(stored(table(spark, sf_dir, "documents")), "media"))


QUERIES = {"op2_media_audio": op2_media_audio}
