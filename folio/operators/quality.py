"""Quality flags of scans from their measured features, and duplicates by perceptual hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Limits of the features.
LIMITS = {"short_edge": 1800, "blur": 80.0, "skew": 2.0, "skew_confidence": 0.2, "illumination": 70.0, "blank": 0.003, "edge": 0.08, "orientation": 0.65}
DISTANCE, BANDS = 3, 4


def flags(scans: DataFrame, limits: dict[str, float] | None = None) -> DataFrame:
    """scans with flags, in a fixed order, and qc_status: review if there are any, else pass. A missing feature raises no flag."""
    m = LIMITS | (limits or {})
    raised = {
        "blur": F.col("blur_laplacian_variance") < m["blur"],
        "skew": (F.col("skew_confidence") >= m["skew_confidence"]) & (F.abs("skew_degrees") > m["skew"]),
        "orientation_suspect": F.col("orientation_gradient_ratio") < m["orientation"],
        "uneven_illumination": F.col("illumination_grid_range") > m["illumination"],
        "blank_page": F.col("ink_coverage") < m["blank"],
        "cropped_or_missing_edge": F.col("edge_ink_ratio") > m["edge"],
        "insufficient_resolution": F.least("width", "height") < m["short_edge"],
    }
    listed = F.array_compact(F.array(*[F.when(c, name) for name, c in raised.items()]))
    return scans.withColumn("flags", listed).withColumn("qc_status", F.when(F.size("flags") > 0, "review").otherwise("pass"))


def duplicates(scans: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(idx, duplicate_of, hash_distance) of (idx, hash bigint, sha256): for each scan the first earlier one with the same sha256 or a hash so near.

    Two hashes that differ in at most so many bits agree in one of as many and one more bands, so only scans that share a band are compared,
    and none is missed, whatever the distance. Scans with the same hash are one group, of which only the first is compared: it is the earliest match they offer.
    """
    bands = max(BANDS, min(distance + 1, 64))
    cuts = [64 * i // bands for i in range(bands + 1)]
    same_sha = scans.where("sha256 is not null").groupBy("sha256").agg(F.min("idx").alias("first"))
    exact = scans.join(same_sha, "sha256").where("first < idx").select("idx", F.col("first").alias("other"))
    firsts = scans.groupBy("hash").agg(F.min("idx").alias("first"))
    twins = scans.join(firsts, "hash").where("first < idx").select("idx", F.col("first").alias("other"))
    banded = firsts.select("hash", "first", F.posexplode(F.array(*[F.shiftright(F.col("hash"), low).bitwiseAND((1 << (high - low)) - 1) for low, high in zip(cuts, cuts[1:], strict=False)])).alias("band", "part"))
    other = banded.select("band", "part", F.col("hash").alias("h2"), F.col("first").alias("f2"))
    near = banded.join(other, ["band", "part"]).where(F.bit_count(F.col("hash").bitwiseXOR(F.col("h2"))).between(1, distance)).select("hash", "h2", "f2").distinct()
    # A later copy of one hash may come after the first of the other.
    reached = scans.select("idx", "hash").join(near, "hash").where("f2 < idx").select("idx", F.col("f2").alias("other"))
    best = exact.unionByName(twins).unionByName(reached).groupBy("idx").agg(F.min("other").alias("duplicate_of"))
    hashes = scans.select("idx", "hash")
    both = best.join(hashes, "idx").join(hashes.select(F.col("idx").alias("duplicate_of"), F.col("hash").alias("h2")), "duplicate_of")
    return both.select("idx", "duplicate_of", F.bit_count(F.col("hash").bitwiseXOR(F.col("h2"))).alias("hash_distance"))
