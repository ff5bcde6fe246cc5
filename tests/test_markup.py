from corpusatlas.functions import markup

PAGE = """<!DOCTYPE html><HTML lang=en><!-- <b> --><head><title>a <i>b</i></title>
<script src='x.js' async>if (a < b) document.write("<u>");</script><style>p > a {}</style></head>
<body CLASS="one" class="two" data-x="a > b"><br/><img src="a.png" alt=''/>
<a href="/?a=1&amp;b=&lt;2" title="it's">x</a><input disabled value = 5><script>never closed <q>"""


def test_names(evaluate):
    assert evaluate(markup.tag_names, [PAGE])[0] == [
        "html", "head", "title", "script", "style", "body", "br", "img", "a", "input", "script",
    ]


def test_attributes(evaluate):
    found = {t.tag: t.attrs for t in evaluate(markup.tags, [PAGE])[0][:10]}
    assert found["html"] == {"lang": "en"}
    assert found["script"] == {"src": "x.js", "async": ""}
    assert found["body"] == {"class": "one", "data-x": "a > b"}
    assert found["br"] == {}
    assert found["img"] == {"src": "a.png", "alt": ""}
    assert found["a"] == {"href": "/?a=1&b=<2", "title": "it's"}
    assert found["input"] == {"disabled": "", "value": "5"}


def test_long_tags(evaluate):
    page = "<a " + " ".join(f'd{i}="{i}"' for i in range(3000)) + ">" + "<b>" * 20000 + "<!--" + "x" * 200000
    tags = evaluate(markup.tags, [page])[0]
    assert len(tags) == 20001 and len(tags[0].attrs) == 3000
