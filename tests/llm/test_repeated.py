"""What a line says again and again is filler; what it lists is not."""

from codelode.llm import residue


def test_repetition():
    again = "Note. " + "Any odd words may stand here. " * 6
    assert residue.kinds(again) == ["filler"]
    assert residue.kinds("It rained. " * 20) == ["filler"]
    assert residue.kinds("Note. One thing is here. Another is there. A third one came. The fourth went. The fifth stays.") == []
    assert residue.kinds("The owner reads the list. The owner reads the list. Then the report is written and sent to everyone who asked for it.") == []


def test_letters_without_order():
    assert residue.kinds("wq zxkj vbnq pqwo rtkk zzpl mnbx qwpe vvkx jjhg wqzx plkm nbvq xzkj qpwo") == ["filler"]
    assert residue.kinds("The weekly report is sent to every owner of a folder and lists what was found there.") == []
