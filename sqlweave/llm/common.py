"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def slices(batches, rows: int = 256):
    """Cut Arrow batches so that one step holds a bounded number of rows' work."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


class Recent:
    """A bounded memo of a pure function: two generations, the older dropped when the newer is full."""

    def __init__(self, make, size: int = 250_000):
        outer, self.size, self.old = self, size, {}

        class Generation(dict):
            def __missing__(self, x):
                y = outer.old.get(x)
                if y is None:
                    y = make(x)
                if len(x) <= 64:  # long keys rarely come back
                    self[x] = y
                return y
        self._new, self.new = Generation, Generation()

    def turn(self):
        """The memo to use for the next text."""
        if len(self.new) >= self.size:
            self.old, self.new = self.new, self._new()
        return self.new


def vocab_path() -> str:
    """Default vocabulary: the public byte-level BPE file; callers may pass another path."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")
