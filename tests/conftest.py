import sys
import uuid
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from cleanloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("tests", 8, **{"spark__checkpoint__dir": str(tmp_path_factory.mktemp("shared"))})
    yield session


GUESTS = """\
101,34.0,120,5,ana@posteo.org,030 4471 220,2024-03-02,2024-03-04
102,61.0,95,12,bo@hotmial.com,0304471221,2024-03-02,2024-03-02
103,,210,0,cy@posteo.org,+49 30 4471222,2024-03-03,2024-03-01
104,-3.0,88,130,dee@gmal.com,0304471223,2024-03-04,2024-03-06
104,28.0,ninety,8,eli.posteo.org,(030) 4471224,2024-03-05,2024-03-07
105,47.0,143,-4,fay@posteo.org,0304471225,2024-03-05,2024-03-09
106,130.0,77,15,  gus@posteo.org,0304471226,2024-03-06,2024-03-08
107,52.0,101,22,hal@yaho.com,030.4471.227,2024-03-07,2024-03-06
108,39.0,99,18,ivy@posteo.org,0304471228,2024-03-08,2024-03-10
109,45.0,134,30,jo@posteo.org,0304471229,2024-03-09,2024-03-12
110,,112,9,kim@posteo.org,0304471230,2024-03-10,2024-03-11
111,58.0,5000,11,lee@outlok.com,030-4471-231,2024-03-11,2024-03-13
112,23.0,118,700,max@posteo.org,0304471232,2024-03-12,2024-03-14
113,71.0,109,14,nia@posteo.org,0304471233,2024-03-13,2024-03-15
114,33.0,97,26,oz@posteo.org,0304471234,2024-03-14,2024-03-17
115,66.0,125,7,pia@posteo.org,0304471235,2024-03-15,2024-03-16
116,,131,19,quinn@posteo.org,0304471236,2024-03-16,2024-03-18
109,45.0,134,30,jo@posteo.org,0304471229,2024-03-09,2024-03-12
"""
HEADER = "guest_id,guest_age,room_price,discount_pct,email,phone,order_date,ship_date"


@pytest.fixture(scope="session")
def guests_csv(tmp_path_factory):
    path = tmp_path_factory.mktemp("csv") / "guests.csv"
    path.write_text(HEADER + "\n" + GUESTS)
    return str(path)


@pytest.fixture(scope="session")
def guests(spark, guests_csv):
    from cleanloom.sources.csv import read_csv

    return read_csv(spark, guests_csv).cache()


@pytest.fixture
def jobs_of(spark):
    """The number of jobs that a call runs, and its result."""
    def counted(call):
        context, group = spark.sparkContext, str(uuid.uuid4())
        context.setJobGroup(group, "counted")
        try:
            result = call()
        finally:
            context.setLocalProperty("spark.jobGroup.id", None)
        context._jsc.sc().listenerBus().waitUntilEmpty()
        return len(context.statusTracker().getJobIdsForGroup(group)), result

    return counted
