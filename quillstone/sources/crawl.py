"""Finding and fetching statute PDFs, and reading their lines.

The crawl is a driver-side loop over a short list of labels with a `fetch` function that the
caller gives, so that it runs without a network in tests. PDF readers are optional.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass
from pathlib import Path
from urllib.parse import parse_qs, quote, urljoin, urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import text as X

LEAST_BYTES = 1024
REPORT = "law string, ok boolean, pdf_path string, search_url string, whole_law_url string, pdf_url string, error string"
BLOCKS = "doc string, page int, width double, height double, blocks array<struct<type: int, lines: array<struct<bbox: array<double>, spans: array<string>>>>>"


@dataclass
class Crawled:
    law: str
    ok: bool = False
    pdf_path: str | None = None
    search_url: str | None = None
    whole_law_url: str | None = None
    pdf_url: str | None = None
    error: str | None = None


def delay(attempt: int, backoff: float = 1.0, most: float = 30.0) -> float:
    """Seconds before the attempt after `attempt` (from 0)."""
    return min(most, backoff * 2**attempt)


def with_retries(call: Callable, retries: int = 3, backoff: float = 1.0, most: float = 30.0, sleep: Callable[[float], None] = time.sleep):
    """The result of the first attempt that raises nothing; the last error after all of them."""
    for attempt in range(retries + 1):
        try:
            return call()
        except Exception:
            if attempt == retries:
                raise
            sleep(delay(attempt, backoff, most))


def links(spark: SparkSession, page: str) -> tuple[list[str], str | None]:
    """The links of a page to complete texts, and its link to a PDF, by the Columns of `functions.text`."""
    r = spark.createDataFrame([(page,)], "page string").select(X.complete_links(F.col("page")), X.pdf_link(F.col("page"))).first()
    return list(r[0]), r[1]


def parameter(url: str, *names: str) -> str | None:
    q = parse_qs(urlparse(url).query)
    return next((q[n][0] for n in names if n in q), None)


def is_pdf(content: bytes) -> bool:
    return len(content) >= LEAST_BYTES and content[:5] == b"%PDF-"


def crawl_one(spark: SparkSession, law: str, folder: str, fetch: Callable[[str], bytes], search: str, matches: Callable[[str, str], bool] = lambda law, page: True, overwrite: bool = False, **retry) -> Crawled:
    """One label: search, pick the first complete text that `matches`, follow its PDF link, check and store the file.

    An existing file that is a PDF is left as it is. Errors are reported, not raised.
    """
    r = Crawled(law)
    path = Path(folder) / (re.sub(r"[^A-Za-z0-9._-]", "_", law) + ".pdf")
    try:
        if not overwrite and path.exists() and is_pdf(path.read_bytes()):
            r.ok, r.pdf_path = True, str(path)
            return r
        get = lambda url: with_retries(lambda: fetch(url), **retry)
        r.search_url = search.format(quote(law))
        for link in links(spark, get(r.search_url).decode("utf-8", "replace"))[0]:
            url = urljoin(r.search_url, link)
            page = get(url).decode("utf-8", "replace")
            if matches(law, page):
                r.whole_law_url = url
                if pdf := links(spark, page)[1]:
                    r.pdf_url = urljoin(url, pdf)
                break
        if not r.pdf_url:
            raise LookupError("no PDF link was found")
        content = get(r.pdf_url)
        if not is_pdf(content):
            raise ValueError("what was fetched is no PDF")
        path.parent.mkdir(parents=True, exist_ok=True)
        temp = path.with_suffix(".part")
        temp.write_bytes(content)
        temp.replace(path)
        r.ok, r.pdf_path = True, str(path)
    except Exception as e:
        r.error = f"{type(e).__name__}: {e}"
    return r


def crawl(spark: SparkSession, laws: list[str], folder: str, fetch: Callable[[str], bytes], search: str, pause: float = 0.0, **how) -> DataFrame:
    """The crawl report as a table."""
    rows = []
    for law in laws:
        rows.append(asdict(crawl_one(spark, law, folder, fetch, search, **how)))
        time.sleep(pause)
    return spark.createDataFrame(rows, REPORT)


def read_pdf_lines(spark: SparkSession, path: str) -> DataFrame:
    """Pages with their text blocks (doc, page, width, height, blocks) of PDF files, if a PDF reader is installed."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            import pymupdf
        except ImportError as e:
            raise RuntimeError("reading PDF files needs the package pymupdf") from e
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                for n, page in enumerate(pymupdf.open(stream=content, filetype="pdf"), 1):
                    blocks = [{"type": x.get("type", 0), "lines": [{"bbox": list(map(float, ln["bbox"])), "spans": [s["text"] for s in ln["spans"]]} for ln in x.get("lines", [])]} for x in page.get_text("dict")["blocks"]]
                    yield pd.DataFrame({"doc": [name.rsplit("/", 1)[-1]], "page": [n], "width": [page.rect.width], "height": [page.rect.height], "blocks": [blocks]})

    return files.mapInPandas(run, BLOCKS)
