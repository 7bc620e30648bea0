"""Operator 3: media columns as interleaved document sequences.

HTML parses into an ordered sequence of text and media-reference structs; a reference names its payload by content
digest (``sha256:<hex>``) and carries its caption. Payloads live in a content-addressed media table, stored losslessly as
8-bit grey samples in PGM files, 64 samples wide, with the unpadded length in a comment of the header. A digest join
resolves references to what was read back; a reference keeps its position and caption whether or not it resolves.

Payload bytes never shuffle: features are computed where stored forms are read, and only they meet the references.

Defined results: a null text is stored as an empty one, which still takes one row of 64 zero samples; equal payloads
share one digest and equal values (stored once per task that meets them); a null doc_id is carried; an empty table gives
no rows; a null or broken html gives the parts that could be read; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, written
from .markup import BLOCK, RAW, attributes, decoded, tags

WIDTH = 64
MEDIA_TAGS = frozenset("img video audio source embed".split())
SEQUENCE = "array<struct<pos: int, kind: string, text: string, digest: string, caption: string>>"
FEATURES = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


# --- stored form ---------------------------------------------------------------------------------------------------


def store(payload: bytes) -> bytes:
    """A PGM file of the payload, padded with zeros to whole rows, one row at least."""
    rows = max(1, -(-len(payload) // WIDTH))
    return b"P5\n# bytes %d\n%d %d\n255\n" % (len(payload), WIDTH, rows) + payload.ljust(WIDTH * rows, b"\0")


_HEADER = re.compile(rb"P5\n# bytes (\d+)\n(\d+) (\d+)\n255\n")


def load(stored: bytes) -> tuple[int, np.ndarray]:
    """Unpadded length and the samples (rows x width)."""
    m = _HEADER.match(stored)
    return int(m[1]), np.frombuffer(stored, np.uint8, offset=m.end()).reshape(int(m[3]), int(m[2]))


def feature(samples: np.ndarray) -> str:
    """Height, mean, deviation, and a 64-bit hash: which of an 8 x 8 grid's cells are brighter than the mean cell."""
    n = len(samples)
    columns = np.add.reduceat(samples, np.arange(0, WIDTH, 8), axis=1, dtype=np.int64)
    edges = np.arange(8) * n // 8
    grid = np.stack([columns[a : max(b, a + 1)].mean(axis=0) for a, b in zip(edges, [*edges[1:], n], strict=True)])
    bits = np.packbits(grid > grid.mean()).tobytes().hex()
    return f"h={n};mean={samples.mean():.4f};std={samples.std():.4f};ahash={bits}"


# --- sequences -----------------------------------------------------------------------------------------------------


def parse(source: str | None) -> list[dict]:
    """Ordered text blocks and media references; a reference in a figure takes its figcaption, else its alt text.

    A figure's captions are held until it ends, at the end of the page at the latest, so they may come before or after its
    references. Captions of a figure without references, and outside of figures, are text blocks at their place.
    """
    out: list[dict] = []
    run: list[str] = []
    figures: list[dict] = []  # open ones: items, items of inner figures that have no caption, captions
    caption: list[str] | None = None  # of the innermost figure

    def clean(parts: list[str]) -> str:
        return " ".join(decoded("".join(parts)).split())

    def merged(a: list[dict], b: list[dict]) -> list[dict]:
        a, b = (a, b) if len(a) >= len(b) else (b, a)  # the longer one grows, so deep nesting costs no more than the page
        a += b
        return a

    def flush() -> None:
        text = clean(run)
        run.clear()
        if text:
            out.append({"pos": 0, "kind": "text", "text": text, "digest": None, "caption": None})

    def end_caption() -> None:
        nonlocal caption
        if caption is not None:
            figures[-1]["captions"][-1]["text"] = clean(caption)
            caption = None

    def end_figure() -> None:
        end_caption()
        flush()
        figure = figures.pop()
        text = " ".join(c["text"] for c in figure["captions"] if c["text"])
        takers = (figure["items"] or figure["inner"]) if text else []
        for item in takers:
            item["caption"] = text
        for held in figure["captions"]:
            held["kind"] = None if takers or not held["text"] else "text"
        if figures:
            bare = [] if takers and not figure["items"] else figure["inner"] if takers else merged(figure["items"], figure["inner"])
            figures[-1]["inner"] = merged(figures[-1]["inner"], bare)

    at, source = 0, source or ""
    for start, _, close, name, rest, stop in tags(source):
        (run if caption is None else caption).append(source[at:start])
        at = stop
        if name in RAW:
            continue
        if name == "figcaption" and figures:
            end_caption()
            flush()
            if not close:
                caption = []
                out.append({"pos": 0, "kind": None, "text": "", "digest": None, "caption": None})
                figures[-1]["captions"].append(out[-1])
        elif name == "figure":
            end_caption()
            flush()
            if not close:
                figures.append({"items": [], "inner": [], "captions": []})
            elif figures:
                end_figure()
        elif name in MEDIA_TAGS and not close:
            flush()
            values = {k: decoded(v) for k, v in attributes(rest) if k in ("src", "alt")}
            if values.get("src"):
                item = {"pos": 0, "kind": "media", "text": None, "digest": values["src"].removeprefix("sha256:"), "caption": values.get("alt") or None}
                out.append(item)
                if figures:
                    figures[-1]["items"].append(item)
        elif name in BLOCK or name in ("br", "option"):
            if caption is None:
                flush()
            else:
                caption.append(" ")
    (run if caption is None else caption).append(source[at:])
    while figures:
        end_figure()
    flush()
    out = [item for item in out if item["kind"]]
    for pos, item in enumerate(out):
        item["pos"] = pos
    return out


def sequences(pages: DataFrame, key: str, source: str) -> DataFrame:
    """(key, sequence) of each page."""
    element = pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "html"):
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([parse(h) for h in some.column(1).to_pylist()], pa.list_(element))], names=["key", "sequence"])

    return pages.select(F.col(key).cast("long").alias("key"), F.col(source).cast("string").alias("html")).mapInArrow(run, f"key long, sequence {SEQUENCE}")


def media_table(payloads: DataFrame) -> DataFrame:
    """Write the stored form of each payload (column ``payload``) under its digest, each once per task, and read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for some in slices(batch, "payload", 8_000_000):
                rows = []
                for p in some.column(0).to_pylist():
                    d = hashlib.sha256(p or b"").digest()
                    if d not in seen:
                        seen.add(d)
                        rows.append((d.hex(), store(p or b"")))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], names=["digest", "stored"])

    return written(payloads.select("payload").mapInArrow(run, "digest string, stored binary"), "media")


def media_features(media: DataFrame) -> DataFrame:
    """What each stored form holds when read back; one row per digest. Written out, so that a join with references deals
    both sides anew and the references of a hot digest can be split over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "stored", 8_000_000):
                rows = []
                for digest, stored in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    n, samples = load(stored)
                    raw = samples.tobytes()
                    rows.append((digest, n, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-WIDTH:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(samples)))
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                names = [f.split()[0] for f in FEATURES.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 8, kinds, strict=True)], names=names)

    return written(media.mapInArrow(run, FEATURES).dropDuplicates(["digest"]), "media-features")


def resolve(sequences: DataFrame, media: DataFrame) -> DataFrame:
    """One row per sequence element, media references with the columns of ``media`` (null where unresolved)."""
    flat = sequences.select("key", F.size("sequence").alias("elements"), F.inline("sequence"))
    columns = [c for c in media.columns if c != "digest"]
    named = media.withColumnRenamed("digest", "media_digest")
    found = flat.where("kind = 'media'").join(named, F.col("digest") == F.col("media_digest"), "left").select(*flat.columns, *columns)
    return found.unionByName(flat.where("kind = 'text'"), allowMissingColumns=True)


def collected(elements: DataFrame, sequences: DataFrame | None = None) -> DataFrame:
    """Resolved sequences again as one array per key, in order of position.

    Elements name no page without any; given the parsed ``sequences``, their keys stay, with an empty array.
    """
    rest = [c for c in elements.columns if c not in ("key", "pos")]
    if sequences is not None:
        elements = elements.unionByName(sequences.where(F.size("sequence") == 0).select("key"), allowMissingColumns=True)
    element = F.when(F.col("pos").isNotNull(), F.struct("pos", *rest))  # null without a position; collect_list leaves it out
    return elements.groupBy("key").agg(F.sort_array(F.collect_list(element)).alias("sequence"))


def page_sequences(pages: DataFrame) -> DataFrame:
    """One row per element of each page's sequence; pages without elements have none."""
    return sequences(pages, "page_id", "html").select(F.col("key").alias("page_id"), F.inline("sequence"))


def documents_as_media(docs: DataFrame) -> DataFrame:
    """Each document's text as the payload of a captioned figure: stored, referred to by HTML, resolved by digest."""
    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    digest = F.sha2(raw, 256)
    page = F.concat(F.lit("<p>document</p><figure><img src=\"sha256:"), digest, F.lit("\"><figcaption>text of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit("</figcaption></figure>"))
    features = media_features(media_table(docs.select(raw.alias("payload"))))
    parsed = sequences(docs.select("doc_id", page.alias("html")), "doc_id", "html")
    return resolve(parsed, features).where("kind = 'media'").select(F.col("key").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pos", "caption")
