import numpy as np
import pytest

from latticework.operators import screening as R

SCHEMA = "subject int, channel string, epoch int, sample int, value double"


@pytest.fixture(scope="module")
def noisy():
    """Subject 0: E3 is loud, E4 flat, E5 silent, epoch 2 loud on what is left; subject 1 is clean."""
    rng = np.random.default_rng(2)
    rows = []
    for s in range(2):
        for c in range(1, 6):
            for e in range(4):
                scale = {3: 40.0, 4: 0.0}.get(c, 1.0) if s == 0 else 1.0
                scale *= 9.0 if s == 0 and e == 2 else 1.0
                rows += [(s, f"E{c}", e, t, None if s == 0 and c == 5 else float(scale * rng.normal())) for t in range(50)]
    return rows


def test_bad_channels_then_epochs(spark, noisy):
    df = spark.createDataFrame(noisy, SCHEMA)
    v = R.variances(df)
    channels = R.judged_channels(v, 500.0)
    epochs = R.judged_epochs(v, channels, 20.0)
    assert {(r["subject"], r["channel"]) for r in channels.filter("rejected").collect()} == {(0, "E3"), (0, "E4"), (0, "E5")}
    assert {(r["subject"], r["epoch"]) for r in epochs.filter("rejected").collect()} == {(0, 2)}
    good = [x[-1] for x in noisy if x[:3] == (0, "E1", 1)], [x[-1] for x in noisy if x[:3] == (0, "E2", 1)]
    one = epochs.filter("subject = 0 and epoch = 1").first()["variance"]
    assert one == pytest.approx(np.mean([np.var(x, ddof=1) for x in good]))
    got = {(r["subject"], r["channel"], r["epoch"]) for r in R.screened(df, channels, epochs).collect()}
    assert got == {(0, f"E{c}", e) for c in (1, 2) for e in (0, 1, 3)} | {(1, f"E{c}", e) for c in range(1, 6) for e in range(4)}
    report = {r["subject"]: tuple(r)[1:] for r in R.screening_report(channels, epochs, wanted=3, seconds=10).collect()}
    assert report == {0: (5, 3, 4, 1, pytest.approx(40 / 60)), 1: (5, 0, 4, 0, pytest.approx(0.5))}
    late = {r["subject"]: r["minutes"] for r in R.screening_report(channels, epochs, wanted=2, seconds=10).collect()}
    assert late[0] == pytest.approx(20 / 60)  # the bad epoch comes after the wanted ones


def test_nothing_left_and_nothing_there(spark, noisy):
    v = R.variances(spark.createDataFrame(noisy, SCHEMA))
    channels = R.judged_channels(v, 1e-9)
    assert R.judged_epochs(v, channels, 20.0).filter("not rejected").count() == 0 and channels.filter("not rejected").count() == 0
    none = R.variances(spark.createDataFrame([], SCHEMA))
    assert R.screening_report(R.judged_channels(none, 1.0), R.judged_epochs(none, R.judged_channels(none, 1.0), 1.0)).count() == 0


def test_rim_goes_by_the_net(spark):
    rows = [(s, f"E{k + 1}") for s, n in ((0, 128), (1, 256), (2, 64)) for k in range(n)] + [(3, f"E{k + 1}") for k in range(128)] + [(3, "X"), (3, "Y"), (2, None)] + [(None, f"E{k + 1}") for k in range(128)]
    got: dict = {}
    for r in R.within_net(spark.createDataFrame(rows, "subject int, channel string"), ["subject"]).collect():
        got.setdefault(r["subject"], set()).add(r["channel"])
    assert {k: len(v) for k, v in got.items()} == {0: 90, 1: 172, 2: 65, 3: 92, None: 90} and not got[0] & set(R.RIM_128) and not got[1] & set(R.RIM_256)
    assert (len(set(R.RIM_128)), len(set(R.RIM_256))) == (38, 84)
