"""Multimodal pages: page text, images and assets from a pluggable extractor, in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

FULL_PAGE = 0.82
_KIND = "page_id long, text string, images int, assets array<string>"
_SCHEMA = pa.schema([("page_id", pa.int64()), ("text", pa.string()), ("images", pa.int32()), ("assets", pa.list_(pa.string()))])


def is_full_page(width: float, height: float, page_width: float, page_height: float) -> bool:
    return width * height >= FULL_PAGE * page_width * page_height


def html_extractor(page: str) -> dict:
    """The default extractor: visible text, image sources and, where both are given in percent of the page, image sizes."""
    shown = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>", " ", page or "")
    tags = [(x, m[1]) for x in re.findall(r"(?i)<img\b[^>]*>", page or "") if (m := re.search(r"(?is).*\bsrc=[\"']?([^\"' >]+)", x))]
    sizes = [[re.search(rf"(?i)[\s\"';]{side}\s*[=:]\s*[\"']?\s*(\d+(?:\.\d+)?)%", x) for side in ("width", "height")] for x, _ in tags]
    sizes = [(float(w[1]), float(h[1])) if w and h else None for w, h in sizes]
    return {"text": " ".join(re.sub(r"<[^>]*>", " ", shown).split()), "images": [src for _, src in tags], "sizes": sizes, "page": (100.0, 100.0)}


def extract(pages: DataFrame, extractor: Callable[[str], dict] = html_extractor, vision: Callable[[str], str] | None = None) -> DataFrame:
    """page_id, text, images, assets: text of the extractor joined with the vision model's where one is given.

    Where the extractor gives its images' sizes and the page's, those that fill the page are no assets: the page image has them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = extractor(page)
                seen = vision(page) if vision else ""
                text = found["text"] if not seen or seen in found["text"] else f"{found['text']}\n\n{seen}".strip()
                parts = sum(not (size and is_full_page(*size, *found["page"])) for size in found.get("sizes") or [None] * len(found["images"]))
                assets = [f"{key}:image:{k:02d}" for k in range(parts)]
                rows.append({"page_id": key, "text": text, "images": len(found["images"]), "assets": assets})
            yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    return pages.select("page_id", "html").mapInArrow(run, _KIND)
