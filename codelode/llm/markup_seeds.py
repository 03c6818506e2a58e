"""Pieces from which the labelled pages are put together; written for this module."""

SENTENCES = (
    "The train leaves at nine and arrives before noon.", "Every guest gets a key and a map of the town.", "Bring warm clothes, since the nights are cold.",
    "About 40 people came to the last meeting.", "오늘은 날씨가 맑아서 산책을 나갔다.", "우체국은 아침 9 시에 문을 연다.", "물이 끓으면 면을 넣고 잘 저어 준다.",
    "It's a long way home, isn't it?", "The page GET /menu/today lists what is cooked, and for whom.", "Mix flour_and_sugar with theRest of it here.",
)
#: what looks like markup and is none
ALIKE = (
    "x == y, and z = w + 2; 30% of $8 is little too.", "Put $EDITOR and $SHELL into the profile.", "6 * 7 * 8 is 400 - 64.", "Ticket #12 is about C# and J# alone.",
    "Take *.md or **/*.css as patterns.", "Choose (a) or (b), then (c).", "~50 files | 7 folders.", "One costs $2 and two cost $3.", "D:\\music\\new is a folder.",
    "Left -> right; up => down & out.", "x < y and y > 3 are both true.", "Either $X or $Y was unset - or both.", "Between $1 and $4, 3 - 2 per day.", "#12 was opened - twice.",
    "List<int> differs from Dict<str, Set<int>>.",
)
CODE_LINES = ("SELECT n FROM m", "let y = g(7);", "while (n > 1) n--;", "do_it(y)", "return y", "make build --fast", "# install first", "- run: make", "* any *", "y = $z$ + 2")
FORMULAS = (r"O(m \log m)", r"\frac{p_k}{q_k - 2}", r"t \ge 7 + v^3", r"y_{n+1} = \beta y_n", "p = q + r", "F = ma", "z", "k+2", r"S = \sum q_i \ln q_i", "g(t)")
