"""Scripts and styles end at their own end tag, whatever they hold."""

import pytest

from prospectra.llm import html_extract

BODY = "<article><p>Some words of the article.</p><p>And more of them.</p></article>"
WANT = ["Some words of the article.", "And more of them."]


@pytest.mark.parametrize(
    "raw",
    [
        "<script>for(i=0;i<n;i++){go()}</script>", "<SCRIPT>if(a<b)c='x</SCRIPT >", "<script>x<y && say(\"it's\")</script>", "<script><!-- a<b</script>",
        "<style>a::before{content:'<p'}</style>", "<style>/* <!-- */</style\n>", "<noscript><img src='x'></noscript>", "<svg><script>if(a<b){}</script><text>no</text></svg>",
        "<template><style>x<y{}</style>no</template>", "<script>var s='</scripts>';a<b</script>",
    ],
)
def test_raw_elements_take_nothing_else(raw):
    assert [b.text for b in html_extract.blocks(raw + BODY)] == WANT
    assert [b.text for b in html_extract.blocks(BODY + raw)] == WANT
    assert [b.text for b in html_extract.blocks(f"<p>First.{raw}Last.</p>{BODY}")] == ["First.", "Last.", *WANT]
