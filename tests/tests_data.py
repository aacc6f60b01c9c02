"""Texts of a small project: a guide to a harbour."""

PROJECT = """[OPTIONS]
Language=0x807
Title=Harbour guide
Full-text search=Yes
Binary Index=Yes
Binary TOC=Yes
Index file=terms.hhk
Contents file=guide.hhc
[FILES]
port/quay.htm
[MAP]
#define TIDE 0x2A
#define FERRY 99
[ALIAS]
QUAY=port/quay.htm
TIDE=tide.htm
[WINDOWS]
wide="Harbour guide","guide.hhc","terms.hhk","port/quay.htm",,,,,,0x2420,180,0x3006,[40,60,640,480],0x14CF0000,,3,,,1
"""


def entry(name, *local):
    params = [("Name", name), *(("Local", x) for x in local)]
    return "<LI> <OBJECT type=\"text/sitemap\">" + "".join(f'<param name="{k}" value="{v}">' for k, v in params) + "</OBJECT>"


def listed(*entries):
    return "<UL>" + "".join(entries) + "</UL>"


CONTENTS = "<BODY>" + listed(entry("Tides", "tide.htm"), entry("Port"), listed(entry("Quay", "port/quay.htm"), entry("Boats", "port/boats.htm")), entry("Weather", "weather.htm")) + "</BODY>"
INDEX = "<BODY>" + listed(entry("Ferry", "port/boats.htm"), listed(entry("tickets", "port/quay.htm")), entry("anchor", "port/quay.htm")) + "</BODY>"
PAGES = {
    "port/quay.htm": "<title>The quay</title><body>Mind the <a href='../tide.htm'>tides</a>, the <a href=boats.htm>boats</a>, a <a href=\"lost/chart.htm\">chart</a> "
    "and <a href='mailto:harbour'>us</a>. <img src='../map.png'></body>",
    "tide.htm": "<title>Tides</title><body>Tides rise twice a day &amp; tides fall 2.5 metres. <a href='/PORT/Quay.htm#steps'>Back</a></body>",
    "port/boats.htm": '<html><title>Boats &amp; crew</title><body><object type="x"><param name="ALink Name" value="boat_kinds"><param name="Keyword" value="Anchor"></object>Ferries and tugs.</body></html>',
    "weather.htm": "<body>Wind from the west</body>",
    "map.png": "PNG",
    "store.htm": "<title>No link leads here</title>",
}
