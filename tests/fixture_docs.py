"""Five small documents of call words, one word a line."""

# The goldens of the tests are computed from these words.
DOCS = {
    "doc1.txt": "papa romeo november november xray delta hotel hotel alpha bravo mike lima hotel",
    "doc2.txt": "bravo papa lima sierra bravo november yankee foxtrot charlie tango kilo sierra alpha mike zulu",
    "doc3.txt": "lima victor kilo india sierra quebec mike india juliet uniform sierra",
    "doc4.txt": "mike echo juliet victor uniform quebec quebec juliet tango hotel romeo",
    "doc5.txt": "november juliet victor yankee oscar alpha echo tango november kilo delta golf quebec papa",
}


def write(directory) -> str:
    for name, words in DOCS.items():
        (directory / name).write_text("".join(w + "\n" for w in words.split()))
    return str(directory)
