"""The cheap first tier: quick statistics and the gate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def gate(p: Column, vacuity: Column, enabled: Column, forced: Column, has_motion: Column, threshold: Column | float = 0.06) -> Column:
    """Ordered rules: off or forced or blind escalates by force; clean and certain exits; else escalates."""
    threshold = F.lit(threshold) if isinstance(threshold, float) else threshold
    return F.when(~enabled | forced | ~has_motion, "escalate_forced").when((p <= threshold) & (vacuity <= 0.5), "early_exit_clean").otherwise("escalate")


def quick_stats(samples: Column) -> dict[str, Column]:
    """Level, crest, zero crossings and silence of an array of samples; 0 where it is empty."""
    n = F.greatest(F.size(samples), F.lit(1))
    total = lambda f: F.aggregate(F.transform(samples, f), F.lit(0.0), lambda a, x: a + x)
    rms = F.sqrt(total(lambda x: x * x) / n)
    signs = F.zip_with(F.slice(samples, 1, F.greatest(F.size(samples) - 1, F.lit(0))), F.slice(samples, 2, F.greatest(F.size(samples), F.lit(0))), lambda x, y: F.when((x < 0) != (y < 0), 1.0).otherwise(0.0))
    return {
        "a_rms": rms,
        "a_crest": F.when(rms > 0, F.array_max(F.transform(samples, F.abs)) / rms).otherwise(F.lit(0.0)),
        "a_zcr": F.aggregate(signs, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(signs), F.lit(1)),
        "a_silence_frac": total(lambda x: F.when(F.abs(x) < 0.1, 1.0).otherwise(0.0)) / n,
    }


def tier_of(memory_gb: Column, cores: Column, gpu: Column) -> Column:
    """Tier by hardware: cloud, consumer or edge."""
    return F.when(gpu & (memory_gb >= 32) & (cores >= 16), "cloud").when((memory_gb >= 8) & (cores >= 4), "consumer").otherwise("edge")
