"""Made-up voices, mixes and bleed, from a seed (SIG-15)."""

import numpy as np

RATE = 1600  # 125 ms are 200 samples


def voice(seed, seconds=40, on=0.5, rate=RATE):
    """Noise in syllables, silent at times: a voice as far as levels and correlations go."""
    r = np.random.default_rng(seed)
    n = seconds * rate
    stretch = rate // 2
    gate = np.repeat(r.random(n // stretch + 1) < on, stretch)[:n]
    swell = 0.6 + 0.4 * np.sin(np.arange(n) * 2 * np.pi * (2 + r.random()) / rate)
    return (r.standard_normal(n) * 0.2 * gate * swell).round(6)


def bleed_into(target, source, share, delay):
    """The target with a weaker, later copy of the source."""
    return target + share * np.concatenate([np.zeros(delay), source[: len(source) - delay]])


def tracks(spark, rows, rate=RATE):
    """Chunks of (call_id, idx, samples)."""
    from confab.operators import signals

    t = spark.createDataFrame([(c, i, [float(x) for x in s]) for c, i, s in rows], "call_id string, idx int, samples array<double>")
    return signals.chunked(t, signals.hop(rate))
