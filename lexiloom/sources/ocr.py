"""Pages of recognised text: JSON blocks of lines to running speech."""

from __future__ import annotations

import json
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "blocks array<struct<lines: array<string>>>"
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}]"


def joined(lines: Column) -> Column:
    """Lines of a block as one text: a space at a seam only between letters of scripts that space their words."""

    def add(text: Column, line: Column) -> Column:
        last, first = F.right(text, F.lit(1)), F.left(line, F.lit(1))
        spaced = last.rlike(r"\p{L}") & first.rlike(r"\p{L}") & ~last.rlike(UNSPACED) & ~first.rlike(UNSPACED)
        return F.when(text == "", line).when(spaced, F.concat(text, F.lit(" "), line)).otherwise(F.concat(text, line))

    kept = F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")
    return F.aggregate(kept, F.lit(""), add)


def blocks(pages: DataFrame) -> DataFrame:
    """The lines of all blocks of pages (page_id, json): page_id, block, line_no, line."""
    each = pages.select("page_id", F.posexplode(F.from_json("json", SCHEMA)["blocks"]).alias("block", "b"))
    return each.select("page_id", "block", F.posexplode("b.lines").alias("line_no", "line"))


def speech(pages: DataFrame) -> DataFrame:
    """What blocks of pages (page_id, json) say: page_id, block, text. Blocks without a letter are left out."""
    blocks = pages.select("page_id", F.posexplode(F.from_json("json", SCHEMA)["blocks"]).alias("block", "b"))
    return blocks.select("page_id", "block", joined(F.col("b.lines")).alias("text")).where(F.col("text").rlike(r"\p{L}"))


class ArchivePart(InputPartition):
    def __init__(self, path: str, name: str, place: int):
        self.path, self.name, self.place = path, name, place


class ArchiveReader(DataSourceReader):
    """One partition for each JSON page of an archive or folder; other members aren't opened."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]

    def names(self) -> list[str]:
        if zipfile.is_zipfile(self.path):
            with zipfile.ZipFile(self.path) as archive:
                return sorted(n for n in archive.namelist() if n.endswith(".json"))
        return sorted(str(p.relative_to(self.path)) for p in Path(self.path).rglob("*.json"))

    def content(self, name: str) -> str:
        if zipfile.is_zipfile(self.path):
            with zipfile.ZipFile(self.path) as archive:
                return archive.read(name).decode("utf-8")
        return (Path(self.path) / name).read_text("utf-8")

    def partitions(self) -> list[ArchivePart]:
        names = self.names()
        meta = next((n for n in names if Path(n).name == "metadata.json"), None)
        listed: list[str] = []
        if meta:
            # Pages are listed by the path of their image; a page's JSON has the same stem.
            listed = [Path(str(p[-1])).stem for p in json.loads(self.content(meta)).get("pages", [])]
        order = {stem: i for i, stem in enumerate(listed)}
        pages = sorted((n for n in names if n != meta), key=lambda n: (order.get(Path(n).stem, len(order)), n))
        return [ArchivePart(self.path, n, i) for i, n in enumerate(pages)]

    def read(self, partition: ArchivePart) -> Iterator[tuple]:
        yield partition.place, partition.name, self.content(partition.name)


class OcrArchive(DataSource):
    """spark.dataSource.register(OcrArchive); spark.read.format("ocr_archive").load(path): page_id, member, json."""

    @classmethod
    def name(cls) -> str:
        return "ocr_archive"

    def schema(self) -> str:
        return "page_id bigint, member string, json string"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)
