"""Bad channels and epochs by variance, channels left out by the net, and what a screening kept."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The channels at the rim of a net, left out of recordings with that many channels.
RIM_128 = (
    "E1 E8 E14 E17 E21 E25 E32 E38 E43 E44 E48 E49 E56 E57 E63 E64 E68 E69 E73 E74 E81 E82 E88 E89 E94 E95 E99 E100 E107 E113 E114 "
    "E119 E120 E121 E125 E126 E127 E128"
).split()
RIM_256 = (
    "E31 E67 E73 E82 E91 E92 E93 E94 E102 E103 E104 E105 E111 E112 E113 E114 E120 E121 E122 E123 E133 E134 E135 E136 E145 E146 E147 "
    "E148 E156 E157 E158 E165 E166 E167 E168 E174 E175 E176 E177 E187 E188 E189 E190 E199 E200 E201 E208 E209 E216 E217 E218 E219 "
    "E225 E226 E227 E228 E229 E230 E231 E232 E233 E234 E235 E236 E237 E238 E239 E240 E241 E242 E243 E244 E245 E246 E247 E248 E249 "
    "E250 E251 E252 E253 E254 E255 E256"
).split()
RIMS = {128: RIM_128, 130: RIM_128, 256: RIM_256}


def within_net(df: DataFrame, keys: Sequence[str], rims: Mapping[int, Sequence[str]] = RIMS) -> DataFrame:
    """Rows without the rim's channels of each recording, which goes by how many distinct channels the recording has; recordings of other nets keep all, rows without a channel stay.

    Channels are counted from a row for each recording and channel; only those to leave out, a few of each recording, meet
    the rows.
    """
    own = df.filter("channel is not null").select(*keys, "channel").distinct()
    nets = own.groupBy(*keys).agg(F.count("*").cast("int").alias("_n"))
    rim = df.sparkSession.createDataFrame([(n, c) for n, names in rims.items() for c in names], "_n int, channel string")
    out = nets.join(F.broadcast(rim), "_n").select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("channel").alias("_channel"))
    same = F.col("channel") == F.col("_channel")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return df.join(out, same, "left_anti")


def variances(df: DataFrame, keys: Sequence[str] = ("subject",)) -> DataFrame:
    """keys, channel, epoch, variance: of each epoch's values on each channel; null where fewer than two are there."""
    return df.groupBy(*keys, "channel", "epoch").agg(F.var_samp("value").alias("variance"))


def judged_channels(variance: DataFrame, most: float, least: float = 0.0, keys: Sequence[str] = ("subject",)) -> DataFrame:
    """keys, channel, variance, rejected: a channel's mean variance over epochs; bad where it is above `most`, or not above `least`, as with a flat or a silent one."""
    mean = variance.groupBy(*keys, "channel").agg(F.avg("variance").alias("variance"))
    return mean.withColumn("rejected", F.coalesce((F.col("variance") > most) | (F.col("variance") <= least), F.lit(True)))


def judged_epochs(variance: DataFrame, channels: DataFrame, most: float, keys: Sequence[str] = ("subject",)) -> DataFrame:
    """keys, epoch, variance, rejected: an epoch's mean variance over the channels that stay; bad where it is above `most`, or where no channel tells."""
    bad = channels.filter("rejected").select(*keys, "channel", F.lit(True).alias("_bad"))
    good = F.when(F.col("_bad").isNull(), F.col("variance"))
    mean = variance.join(bad, [*keys, "channel"], "left").groupBy(*keys, "epoch").agg(F.avg(good).alias("variance"))
    return mean.withColumn("rejected", F.coalesce(F.col("variance") > most, F.lit(True)))


def screened(df: DataFrame, channels: DataFrame, epochs: DataFrame, keys: Sequence[str] = ("subject",)) -> DataFrame:
    """Rows of neither a bad channel nor a bad epoch."""
    out = df.join(channels.filter("rejected").select(*keys, "channel"), [*keys, "channel"], "left_anti")
    return out.join(epochs.filter("rejected").select(*keys, "epoch"), [*keys, "epoch"], "left_anti")


def screening_report(channels: DataFrame, epochs: DataFrame, keys: Sequence[str] = ("subject",), wanted: int = 60, seconds: float = 10.0) -> DataFrame:
    """keys, n_channels, n_bad_channels, n_epochs, n_bad_epochs, minutes.

    Minutes are those that had to be looked through for `wanted` good epochs: these, and the bad ones among the first
    `wanted`. Epochs count from a recording's first.
    """
    of_channels = channels.groupBy(*keys).agg(F.count("*").alias("n_channels"), F.count_if("rejected").alias("n_bad_channels"))
    first = epochs.groupBy(*keys).agg(F.min("epoch").alias("_first"))
    early = F.count_if(F.col("rejected") & (F.col("epoch") - F.col("_first") < wanted))
    of_epochs = epochs.join(first, list(keys)).groupBy(*keys).agg(F.count("*").alias("n_epochs"), F.count_if("rejected").alias("n_bad_epochs"), ((wanted + early) * seconds / 60.0).alias("minutes"))
    return of_channels.join(of_epochs, list(keys)).select(*keys, "n_channels", "n_bad_channels", "n_epochs", "n_bad_epochs", "minutes")
