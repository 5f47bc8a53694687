import pytest

from halfeven.errors import EngineError
from halfeven.functions import types as ty
from halfeven.functions.types import BIGINT, BOOLEAN, decimal


@pytest.mark.parametrize(
    "op, x, y, out",
    [
        ("+", decimal(3, 2), decimal(4, 3), decimal(5, 3)),
        ("/", decimal(3, 2), decimal(2, 1), decimal(8, 6)),
        ("*", decimal(8, 2), decimal(6, 3), decimal(14, 5)),
        ("*", decimal(12, 2), BIGINT, decimal(18, 0)),
        ("%", decimal(8, 2), decimal(6, 3), decimal(6, 3)),
        ("+", BIGINT, BIGINT, BIGINT),
        ("-", decimal(18, 0), decimal(18, 9), decimal(18, 0)),
    ],
)
def test_arithmetic(op, x, y, out):
    assert ty.arithmetic(op, x, y) == out


def test_aggregates():
    assert ty.averaged(BIGINT) == decimal(18, 0)
    assert ty.averaged(decimal(8, 2)) == decimal(18, 6)
    assert ty.summed(decimal(8, 2)) == decimal(18, 2)
    assert ty.rounded(decimal(8, 3), 1) == decimal(6, 1)


def test_families():
    ty.comparable(BIGINT, decimal(3, 1))
    with pytest.raises(EngineError):
        ty.comparable(BIGINT, BOOLEAN)
    with pytest.raises(EngineError):
        ty.rounded(BIGINT, 1)
