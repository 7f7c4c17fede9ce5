"""Hand-made sample pages: the small labelled table of the main-text tree. data-main marks what belongs to the article."""

_WORDS = "the boat left early that morning and nobody on shore knew why it would not return before the long winter storm".split()


def _w(n: int, start: int = 0, end: str = ".") -> str:
    return " ".join(_WORDS[(start + i * 7) % len(_WORDS)] for i in range(n)) + end


def _links(n: int) -> str:
    return "".join(f"<li><a href='/{i}'>{_w(1 + i % 3, i, '')}</a></li>" for i in range(n))


def _ps(*sizes: int) -> str:
    return "".join(f"<p data-main=\"1\">{_w(n, i)}</p>" for i, n in enumerate(sizes))


_YES, _NO = 'data-main="1"', 'data-main="0"'

SAMPLES = (
    # semantic tags, short and long paragraphs
    f"<body {_NO}><nav><ul>{_links(6)}</ul></nav><article {_YES}><h1>{_w(7, 3, '')}</h1>{_ps(60, 1, 45, 2, 120, 1, 8)}</article><footer {_NO}>{_w(12)}</footer></body>",
    f"<body {_NO}><header {_NO}><h2>{_w(3, 1, '')}</h2><p>{_w(6)}</p></header><main {_YES}><article><h1>{_w(9, 2, '')}</h1>{_ps(30, 4, 3, 70)}<ul><li>{_w(4)}</li><li>{_w(9)}</li></ul></article></main>"
    f"<aside {_NO}><h3>{_w(2, 0, '')}</h3><ul>{_links(5)}</ul><p>{_w(25)}</p></aside><footer {_NO}><p>{_w(40)}</p></footer></body>",
    f"<body {_NO}><div class='ad' {_NO}>{_w(4)}</div><article {_YES}><h1>{_w(5, 5, '')}</h1><p>{_w(1)}</p><p>{_w(1)}</p><p>{_w(2)}</p></article><div class='ad' {_NO}>{_w(30)}</div><footer {_NO}>{_w(5)}</footer></body>",
    # classes and ids only
    f"<body {_NO}><div id='header' {_NO}>{_w(4, 0, '')}</div><div class='menu'><ul>{_links(8)}</ul></div><div class='post-content' {_YES}><h2>{_w(6, 1, '')}</h2>{_ps(25, 80, 5)}<blockquote>{_w(20)}</blockquote></div>"
    f"<div class='comments' {_NO}><p>{_w(35)}</p><p>{_w(12)}</p><p>{_w(60)}</p></div><div id='footer' {_NO}>{_w(9)}</div></body>",
    f"<body {_NO}><div class='cookie-notice' {_NO}>{_w(28)}</div><div class='entry' {_YES}><h1>{_w(4, 0, '')}</h1>{_ps(3, 40, 1, 55)}<div class='newsletter' {_NO}><p>{_w(15)}</p></div>{_ps(22, 6)}<div class='related' {_NO}><ul>{_links(4)}</ul></div></div>"
    f"<div class='sidebar' {_NO}><p>{_w(18)}</p><p>{_w(45)}</p></div></body>",
    # a header within the article, a form and an advert inside it
    f"<body {_NO}><header {_NO}><p>{_w(3, 0, '')}</p><p>{_w(14)}</p></header><article {_YES}><header {_YES}><h1>{_w(8, 2, '')}</h1><p class='byline' {_NO}>{_w(4)}</p></header>{_ps(50, 2)}<div class='ads' {_NO}>{_w(16)}</div>{_ps(33)}"
    f"<form {_NO}><p>{_w(7)}</p></form><p {_YES}>{_w(18)} <a href='/x'>{_w(2, 0, '')}</a></p></article><section class='comments' {_NO}><article class='comment'><p>{_w(44)}</p></article><article class='comment'><p>{_w(3)}</p></article></section></body>",
    # no marks at all: length, link density and neighbours decide
    f"<body {_NO}><div>{_w(2, 0, '')}</div><table><tr><td><a href='/'>{_w(1, 0, '')}</a></td><td><a href='/a'>{_w(2, 0, '')}</a></td></tr></table><div><h1 {_YES}>{_w(6, 0, '')}</h1>{_ps(40, 65, 28, 90, 35)}</div><div>{_w(5, 0, '')}</div><ul>{_links(7)}</ul></body>",
    f"<body {_NO}><ul>{_links(9)}</ul><p>{_w(3, 0, '')}</p><div><h2 {_YES}>{_w(5, 0, '')}</h2>{_ps(70, 22, 14, 48, 31)}</div><p><a href='/t'>{_w(4, 0, '')}</a></p><p>{_w(6, 0, '')}</p><ul>{_links(5)}</ul></body>",
    f"<body {_NO}><p><a href='/'>{_w(2, 0, '')}</a> | <a href='/b'>{_w(2, 0, '')}</a></p>{_ps(55, 18, 61, 24)}<p>{_w(30)[:0]}<a href='/c'>{_w(9, 0, '')}</a></p><p>{_w(4, 0, '')}</p></body>",
    f"<body {_NO}><div>{_w(4, 0, '')}</div><div {_YES}>{_w(80)}</div><div {_YES}>{_w(45)}</div><div {_YES}>{_w(36)}</div><div>{_w(3, 0, '')}</div></body>",
    # lists of links within main, footers with prose, menus in article
    f"<body {_NO}><main {_YES}><h1>{_w(3, 0, '')}</h1>{_ps(20, 12)}<nav {_NO}><ul>{_links(4)}</ul></nav>{_ps(9, 2)}<p {_YES}>{_w(3, 0, ' ')}<a href='/y'>{_w(1, 0, '.')}</a></p></main><footer {_NO}><p>{_w(22)}</p><p>{_w(51)}</p></footer></body>",
    f"<body {_NO}><div class='notice' {_NO}><p>{_w(33)}</p></div><section id='content' {_YES}><h1>{_w(4, 0, '')}</h1><h2>{_w(2, 0, '')}</h2>{_ps(15)}<h2 {_YES}>{_w(3, 0, '')}</h2>{_ps(64, 1)}<pre>{_w(8)}</pre><table><tr><td>{_w(2, 0, '')}</td><td>{_w(3, 0, '')}</td></tr></table></section>"
    f"<div class='footer' {_NO}><p>{_w(19)}</p></div></body>",
)
