"""HTML extraction: what stands beside the core."""

from inkgraph.llm import html_text as H

LINKS = "<ul>" + "".join(f"<li><a href=/{k}>Menu entry {k}</a></li>" for k in range(8)) + "</ul>"
LONG = [f"Paragraph {k} " + "of a text that goes on for a while with words and more words. " * 4 for k in range(6)]


def paragraphs(*ks):
    return "".join(f"<p>{LONG[k]}</p>" for k in ks)


def text(*ks):
    return "\n".join(LONG[k].strip() for k in ks)


def test_unlabelled_wrapper_loses_links_and_small_print():
    page = f"<html><body><div id=page><div>{LINKS}</div><div>{paragraphs(0, 1, 2)}</div><div>Some small print of 2020</div></div></body></html>"
    assert H.main_text(page) == text(0, 1, 2)


def test_heading_outside_the_core_stays():
    page = f"<body><div><div>{LINKS}</div><h1>Title</h1><div><div>{paragraphs(0, 1, 2)}</div></div><h2>More</h2><div>{LINKS}</div></div></body>"
    assert H.main_text(page) == "Title\n" + text(0, 1, 2)


def test_sibling_sections_of_the_body_stay():
    page = f"<body><div>{LINKS}</div><div>{paragraphs(0, 1, 2)}</div><div><h2>Next</h2>{paragraphs(3)}</div><div>{paragraphs(4, 5)}</div><div>{LINKS}</div></body>"
    assert H.main_text(page) == text(0, 1, 2) + "\nNext\n" + text(3) + "\n" + text(4, 5)


def test_several_articles_stay():
    page = f"<body><div><div>{LINKS}</div><article><h2>One</h2>{paragraphs(0, 1, 2)}</article><article><h2>Two</h2>{paragraphs(3)}</article><div><article>{paragraphs(4)}</article></div><div>{LINKS}</div></div></body>"
    assert H.main_text(page) == "One\n" + text(0, 1, 2) + "\nTwo\n" + text(3) + "\n" + text(4)


def test_main_ends_the_climb():
    page = f"<body><div>{paragraphs(3)}</div><main><div>{paragraphs(0, 1, 2)}</div></main></body>"
    assert H.main_text(page) == text(0, 1, 2)


def test_loose_text_beside_the_core_stays():
    page = f"<body><div>{LONG[3]}<b>bold words</b> <div>{paragraphs(0, 1, 2)}</div><div>{LINKS}</div></div></body>"
    assert H.main_text(page) == LONG[3] + "bold words\n" + text(0, 1, 2)
