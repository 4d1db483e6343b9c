import datetime as dt

import pytest

from netstate.session import local_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session(8, 4)


@pytest.fixture(scope="session")
def sf():
    return SF


def moment(seconds: float) -> dt.datetime:
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


TIMELINE = ("source string, segment int, pos long, row long, timestamp timestamp_ntz, risk double, headline_stage string, "
            "attack_prob array<double>")


def timeline_of(spark, risks, stages="Impact", source="a", segment=0):
    """A scored time line of one segment from risks and stages."""
    stages = [stages] * len(risks) if isinstance(stages, str) else stages
    rows = [(source, segment, i, i, moment(10 * i), float(r), s, [float(r)] * 6)
            for i, (r, s) in enumerate(zip(risks, stages))]
    return spark.createDataFrame(rows, TIMELINE)
