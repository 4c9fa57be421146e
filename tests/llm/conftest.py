import pytest

from sparktrend.llm import links


@pytest.fixture(autouse=True)
def few_tasks(monkeypatch):
    """Small tables need no 32 tasks a step, each of which costs a worker's start."""
    monkeypatch.setattr(links, "PARTS", 4)
