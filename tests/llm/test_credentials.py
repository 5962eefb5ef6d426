"""Random tokens count without a listed word directly before them."""

from codeloom.llm.credentials import scan_line


def test_unnamed_random_tokens():
    for line in ('puts "using 8I4DVZGQ98bvBxfKhfVq06 for index"', '"debug auth HbnIe54NysFysLtCQeLAj1 sent"', 'puts "login ok with pass zlbzELkzkows3jNh8tG0Tc"'):
        [(start, end, kind)] = scan_line(line)
        assert len(line[start:end]) == 22 and kind == "random"


def test_names_still_give_the_kind():
    assert [x[2] for x in scan_line('api_key = "4TQ6ZHhCBcQg6GQswctI69WVKRDNLJyeWhjbrJul"')] == ["secret"]


def test_hashes_ids_and_names_are_none():
    for value in ("d574abe9d26fcf5f642ddd83cd12ae00dfcd60702d43e9ea", "123e4567-e89b-12d3-a456-426614174000", "replayGraphBoundIndex2Map", "SPDX-License-Identifier"):
        assert scan_line(f'x = "{value}"') == []
    assert scan_line('cacheVersion = "8I4DVZGQ98bvBxfKhfVq06"') == []
