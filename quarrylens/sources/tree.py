"""A directory tree as files(path, abs_path, size, is_symlink, is_file, binary, text), a Python data source read slice by slice.

The driver only lists the top folders into slices; each executor walks and reads its own slices of the shared file system. Names that begin
with a dot or an underscore are read like others. Text is UTF-8 without malformed bytes, line ends as LF.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quarrylens.functions.columns import GENERATED_SEGMENTS, IMAGE_FILES, TEXT_SUFFIXES, file_name, has_segment, suffix, under
from quarrylens.runtime import ship

SCHEMA = "path string, abs_path string, size long, is_symlink boolean, is_file boolean, binary boolean, text string"
MOST_BYTES, MOST_FILES, PROBE = 1_000_000, 10_000, 1024
PRUNED = frozenset(GENERATED_SEGMENTS)
ASIDE = tuple(".github .claude archive build common dist docs example examples fixture fixtures sample samples shared/report/examples workspace".split())
PRESETS = {
    "full-repo": ((), ()),
    "source-only": ((), (*ASIDE, *"shared/tools shared/tests test tests".split())),
    "dogfood": (tuple("app domains lib shared/python shared/tests src tests".split()), ASIDE),
    "self-audit": (tuple("docs/roadmap domains shared/python shared/tests shared/tools tests".split()), ()),
}


class _Slice(InputPartition):
    def __init__(self, folder: str, deep: bool) -> None:
        self.folder, self.deep = folder, deep


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root = os.path.abspath(options["path"])
        self.most = int(options.get("maxbytes", MOST_BYTES))
        self.slices = int(options.get("slices", 64))

    def partitions(self) -> list[InputPartition]:
        """Folders of the upper levels until there are enough to share out; files of a split folder are a slice of their own."""
        whole, split = [""], []
        while whole and len(whole) < self.slices:
            lower: list[str] = []
            for folder in whole:
                with os.scandir(os.path.join(self.root, folder)) as entries:
                    lower += [os.path.join(folder, e.name) for e in entries if e.is_dir(follow_symlinks=False)]
            split += whole
            whole = lower
        return [*(_Slice(x, False) for x in split), *(_Slice(x, True) for x in whole)]

    def read(self, part: _Slice) -> Iterator[tuple]:
        for folder, folders, names in os.walk(os.path.join(self.root, part.folder)):
            for name in sorted(names + [d for d in folders if os.path.islink(os.path.join(folder, d))]):
                yield self.row(os.path.join(folder, name))
            if not part.deep:
                break

    def row(self, full: str) -> tuple:
        path = os.path.relpath(full, self.root).replace(os.sep, "/")
        if os.path.islink(full):
            return path, full, None, True, False, None, None
        size = os.path.getsize(full)
        if not os.path.isfile(full) or size > self.most or PRUNED & set(path.split("/")):
            return path, full, size, False, os.path.isfile(full), None, None
        with open(full, "rb") as f:
            raw = f.read()
        if b"\x00" in raw[:PROBE]:
            return path, full, size, False, True, True, None
        return path, full, size, False, True, False, raw.decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n")


class Tree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_tree(spark: SparkSession, root: str, **options: int) -> DataFrame:
    """All entries of a tree, wanted or not."""
    ship(spark)
    spark.dataSource.register(Tree)
    return spark.read.format("source_tree").options(**options).load(root)


def preset_filters(root: str, mode: str, include: list[str], exclude: list[str]) -> tuple[list[str], list[str]]:
    """Include and exclude paths of a scope mode; of a preset only what exists counts."""
    if mode not in PRESETS:
        raise ValueError(f"unknown scope mode {mode}; there are {', '.join(PRESETS)}")
    tidy = lambda xs: [y for x in xs if (y := x.replace("\\", "/").strip("/"))]
    there = lambda xs: [x for x in xs if os.path.exists(os.path.join(root, x))]
    want, drop = PRESETS[mode]
    chosen = tidy(include) or there(want)
    if mode == "dogfood" and not chosen:
        return preset_filters(root, "source-only", include, exclude)
    return chosen, sorted({*tidy(exclude), *there(drop)})


def ignore_patterns(root: str, file: str = ".inspectignore") -> list[str]:
    """Path prefixes of an ignore file; # begins a comment."""
    at = os.path.join(root, file)
    if not os.path.isfile(at):
        return []
    with open(at, encoding="utf-8") as f:
        return [x for raw in f if (x := raw.strip()) and not x.startswith("#")]


def supported(path: Column) -> Column:
    return suffix(path).isin(*TEXT_SUFFIXES) | file_name(path).isin(*IMAGE_FILES)


def select_targets(entries: DataFrame, include=(), exclude=(), most_bytes: int = MOST_BYTES, most_files: int | None = None) -> DataFrame:
    """entries with skip_reason: null for a target, '' for what is out of scope without a word, else why it is skipped.

    The rules hold in order: symlink, no file, out of scope, generated, suffix, size, binary, count. most_files (None: no cap) keeps the first by path.
    """
    p = F.col("path")
    outside = F.lit(False) if not include else ~under(p, include)
    reason = (
        F.when(F.col("is_symlink"), "symlink-skipped")
        .when(~F.col("is_file"), "")
        .when(outside | under(p, exclude), "")
        .when(has_segment(p, GENERATED_SEGMENTS), "generated-path-skipped")
        .when(~supported(p), "unsupported-suffix")
        .when(F.col("size") > most_bytes, "max-file-size-exceeded")
        .when(F.col("binary"), "binary-skipped")
    )
    out = entries.withColumn("skip_reason", reason)
    if most_files is not None:
        place = F.row_number().over(Window.partitionBy(F.col("skip_reason").isNull()).orderBy("path"))
        out = out.withColumn("skip_reason", F.when(F.col("skip_reason").isNull() & (place > most_files), "scan-file-count-limit-exceeded").otherwise(F.col("skip_reason")))
    return out


def synthetic_tree(spark: SparkSession, n: int) -> DataFrame:
    """n generated modules with eleven bodies in turn, as files(path, abs_path, text): the bench's input."""
    bodies = [
        "    total = x + VALUE\n    return total", "    total = x - VALUE\n    return total", "    if x < 0:\n        return VALUE - x\n    return x + VALUE",
        "    if x % 2 == 0:\n        return x + VALUE\n    return x - VALUE", "    total = x\n    total += VALUE\n    return total", "    total = x\n    total -= VALUE\n    return total",
        "    total = VALUE\n    total += x\n    return total", "    total = VALUE\n    total -= x\n    return total", "    part = VALUE // 2\n    return x + part",
        "    part = VALUE // 3\n    return x - part", "    result = x * 2\n    result += VALUE\n    return result",
    ]
    body = F.element_at(F.array(*map(F.lit, bodies)), (F.col("id") % 11 + 1).cast("int"))
    text = F.concat(F.format_string('"""Generated module %d."""\n\nVALUE = %d\n\ndef compute(x: int) -> int:\n', "id", F.col("id") + 1000), body, F.lit("\n"))
    path = F.format_string("src/module_%04d.py", "id")
    return spark.range(n).select(path.alias("path"), path.alias("abs_path"), text.alias("text"))
