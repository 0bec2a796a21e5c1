"""Engine options, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Options:
    """row_group_bytes and page_bytes of data files, keys a file's bloom filter expects, when compaction is due, and the order of keys, which data files carry in their metadata."""

    row_group_bytes: int = 128 << 20
    page_bytes: int = 16 << 10
    bloom_keys: int = 1_000_000
    level0_files: int = 4
    level_base_bytes: int = 10 << 20
    codec: str = "zstd"
    order: str = "bytewise"

    def __post_init__(self):
        for f in fields(self):
            value = getattr(self, f.name)
            if f.name not in ("codec", "order") and (not isinstance(value, int) or value <= 0):
                raise ValueError(f"{f.name} must be a positive number, not {value!r}")
        if self.codec not in ("none", "snappy", "gzip", "lz4", "zstd"):
            raise ValueError(f"codec {self.codec!r} is not known")
        if self.order != "bytewise":
            raise ValueError(f"order {self.order!r} is not known; keys sort bytewise")
        if self.page_bytes > self.row_group_bytes:
            raise ValueError("a page cannot be larger than its row group")

    def writer(self) -> dict[str, str]:
        """Options for df.write.options(...).parquet."""
        return {"parquet.block.size": str(self.row_group_bytes), "parquet.page.size": str(self.page_bytes), "compression": self.codec, "parquet.writer.order": self.order}
