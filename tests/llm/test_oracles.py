import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from compare import database, same  # noqa: E402

from kerbline.llm.oracles import ORACLES  # noqa: E402
from kerbline.llm.queries import QUERIES  # noqa: E402


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, sf_dir, name):
    same(QUERIES[name](spark, sf_dir), ORACLES[name], database(sf_dir))
