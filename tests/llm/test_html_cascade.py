"""Which style holds, and where cells stand under cells of several rows."""

from __future__ import annotations

import pytest

from seqspark.llm.html_text import render

CASES = [
    ("<style>p{display:none} p.v{display:inline}</style><p class=v>x</p>", "x"),  # specificity
    ("<style>p.v{display:inline} p{display:none}</style><p class=v>x</p><p>y</p>", "x"),
    ("<style>.h{display:none} .h{display:block}</style><p class=h>x</p>", "x"),  # order
    ("<style>.h{display:block} .h{display:none}</style><p class=h>x</p>", ""),
    ("<style>p{display:none}</style><p style='display:block'>x</p>", "x"),  # inline over sheet
    ("<style>p{display:none!important}</style><p style='display:block'>x</p>", ""),
    ("<style>p{display:none ! important} p#i{display:block}</style><p id=i>x</p>", ""),
    ("<p style='--x:display:none'>x</p>", "x"),  # custom properties
    ("<style>p{--display:none;-x-display:none}</style><p>x</p>", "x"),
    ("<p style='display:none;display:block'>x</p><p style='display:block;display:none'>y</p>", "x"),
    ("<p style='display:none 5px'>x</p><p style='display: NONE'>y</p>", "x"),  # a value that is none
    ("<style>.a > .b .c{display:none}</style><div class=a><div class=b><div class=b><p class=c>x</p></div></div></div>", ""),  # going back
    ("<style>.a > .b > .c{display:none}</style><div class=a><div class=b><div><p class=c>x</p></div></div></div>", "x"),
    ("<style>.a .b{display:none}</style><div class=b>x</div><div class=a><i>y</i><div class=b>z</div></div>", "x\ny"),
    ("<p hidden>x</p><p hidden style='display:block'>y</p>", "y"),
    ("<style>#i{visibility:hidden} i{visibility:visible}</style><p id=i>x<i>y</i>z</p>", "y"),
    ("<p style='visibility:hidden'>x<b style='visibility:initial'>y</b><b style='visibility:inherit'>z</b></p>", "y"),
    ("<noscript>x</noscript>y", "y"),
]


@pytest.mark.parametrize(("page", "text"), CASES)
def test_cascade(page, text):
    assert render(page) == text


def test_rows_under_a_spanning_cell():
    page = "<table><tr><td rowspan=2>aaa<td>b<td>c<tr><td>dd<td>e<tr><td>f<td>g<td>h</table>"
    assert render(page) == "aaa  b   c\n     dd  e\nf    g   h"
    page = "<table><tr><td>a<td rowspan=3>b<td>c<tr><td>d<td>e<tr><td>f<td>g<tr><td>h<td>i<td>j</table>"
    assert render(page).split("\n") == ["a  b  c", "d     e", "f     g", "h  i  j"]
    page = "<table><tr><td colspan=2 rowspan=2>ab<td>c<tr><td>d<tr><td>e<td>f<td>g</table>"
    assert [x.split() for x in render(page).split("\n")] == [["ab", "c"], ["d"], ["e", "f", "g"]]
    assert render("<table><tr><td rowspan=99999>a<td rowspan=0>b<tr><td>c</table>") == "a  b\n   c"
