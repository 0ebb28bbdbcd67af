"""File digests over BINARY content as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK, SAMPLE = 4096, 1024


def block_crc32(content: Column) -> Column:
    """Exclusive-or of the CRC-32 of every 4096-byte block; 0 for empty content."""
    blocks = F.sequence(F.lit(0), F.floor((F.length(content) - 1) / BLOCK).cast("int"))
    crcs = F.transform(blocks, lambda i: F.crc32(F.substring(content, i * BLOCK + 1, F.lit(BLOCK))))
    return F.when(F.length(content) == 0, F.lit(0).cast("bigint")).when(content.isNotNull(), F.aggregate(crcs, F.lit(0).cast("bigint"), lambda a, b: a.bitwiseXOR(b)))


def sparse_md5(content: Column) -> Column:
    """MD5 of 1024-byte samples at 0, 1 KB, 4 KB, 16 KB and so on up to 1 GB; samples behind the end are empty."""
    offsets = [0, *(SAMPLE << (2 * i) for i in range(11))]
    return F.md5(F.concat(*[F.substring(content, o + 1, SAMPLE) for o in offsets]))


def digest(content: Column, algorithm: Column | str) -> Column:
    """Digest as text by its algorithm's name: sha256, md5 or crc32; null for others."""
    a = F.lit(algorithm) if isinstance(algorithm, str) else algorithm
    return F.when(a == "sha256", F.sha2(content, 256)).when(a == "md5", F.md5(content)).when(a == "crc32", block_crc32(content).cast("string"))
