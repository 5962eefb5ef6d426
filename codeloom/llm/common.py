"""What the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows handed to Python at once; with texts of up to 64 KB a batch stays small.
BATCH_ROWS = 1000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def map_columns(
    df: DataFrame,
    fn: Callable[[dict[str, list]], dict[str, list]],
    schema: T.StructType | str,
) -> DataFrame:
    """Apply ``fn`` to batches of columns, as Python lists, without a shuffle.

    ``fn`` gets a dict of equally long lists and returns one for ``schema``; it
    may return more or fewer rows than it got.
    """
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(start, BATCH_ROWS)
                names = part.schema.names
                out = fn({n: part.column(i).to_pylist() for i, n in enumerate(names)})
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow
                )

    return df.mapInArrow(run, kind)


def files(nodes: DataFrame) -> DataFrame:
    """FILE nodes that have a source; repeated deliveries are still in it."""
    return nodes.where((F.col("kind") == "FILE") & F.col("source").isNotNull())


def language_of(path: str | None) -> str | None:
    """The language that a file extension stands for."""
    if not path:
        return None
    return EXTENSIONS.get(path.rsplit(".", 1)[-1].lower()) if "." in path else None


# File extensions of the fourteen languages.
EXTENSIONS = {
    "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hh": "cpp", "hpp": "cpp", "hxx": "cpp",
    "go": "go", "java": "java", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript",
    "json": "json", "kt": "kotlin", "kts": "kotlin", "php": "php", "py": "python", "pyi": "python",
    "rb": "ruby", "rs": "rust", "sh": "shell", "bash": "shell", "zsh": "shell", "swift": "swift",
    "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript",
}

# Other spellings of the languages' names.
SPELLINGS = {
    "c++": "cpp", "cplusplus": "cpp", "cc": "cpp", "golang": "go", "js": "javascript", "ecmascript": "javascript",
    "node": "javascript", "jsx": "javascript", "kt": "kotlin", "py": "python", "python3": "python", "rb": "ruby",
    "rs": "rust", "sh": "shell", "bash": "shell", "zsh": "shell", "shellscript": "shell", "ts": "typescript",
    "tsx": "typescript", "h": "c",
}

LANGUAGES = frozenset(EXTENSIONS.values())


def canonical_language(name: str | None) -> str | None:
    """One of the fourteen languages for any usual spelling, else None."""
    if name is None:
        return None
    low = name.strip().lower()
    low = SPELLINGS.get(low, low)
    return low if low in LANGUAGES else None
