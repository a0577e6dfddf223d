import re

import pytest


@pytest.fixture(scope="session")
def words():
    """A small vocabulary for made-up texts."""
    import random

    rnd = random.Random(7)
    return ["".join(rnd.choice("abcdefghiklmnoprstu") for _ in range(rnd.randint(2, 8))) for _ in range(400)]


SPACE = re.compile(r"[^\x20\x09-\x0D]+")
