import pytest

from corpusweave import config


def test_values():
    assert config.as_bool(" Yes ") and not config.as_bool("off") and config.as_bool(None, True)
    assert config.tier("Gem:a:b") == ("gem", "a:b") and config.tier(" NIM ") == ("nim", None)


def test_first_answer():
    def ask(provider, model):
        if provider == "a":
            raise TimeoutError
        if provider == "b":
            return ""
        if provider == "c":
            raise KeyError("bad request")
        return f"{provider}/{model}"

    assert config.first_answer(["a", "b", "d:m"], ask, (TimeoutError,)) == "d/m"
    with pytest.raises(KeyError):
        config.first_answer(["a", "c", "d:m"], ask, (TimeoutError,))
    with pytest.raises(TimeoutError):
        config.first_answer(["a"], ask, (TimeoutError,))
