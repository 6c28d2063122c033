"""Texts written and judged by hand, for the calibration of problem 9. They take no part in training, and none is from a corpus."""

from __future__ import annotations

CHECKED: list[tuple[str, str]] = [
    ("The mayor opened the new bridge on\nTuesday morning before a large crowd.\nHe thanked the workmen, who had built\nit in less than a year, and said that\nthe town would not forget them.", "prose"),
    ("A fire broke out last night at the\nold bakehouse in Mill Lane. The neigh-\nbours carried water from the river, but\nthe roof had fallen in before the engine\ncame. Nobody was hurt.", "prose"),
    ("Tbe weather has been so dry that farmers\nin the valley fear for their hay. One of\nthem told us that he had never seen thc\nbrook so low, and that his cows must\ndrink from the well.", "prose"),
    ("FOR SALE, a brown mare, quiet in harness.\nAfter the meeting the members walked\nto the hall, where tea was served by\nthe ladies of the parish. The band played\nuntil nine o'clock.", "prose"),
    ("Le train de Paris est arrivé avec deux\nheures de retard, parce que la neige cou-\nvrait encore la voie. Les voyageurs ont\npassé la nuit dans la salle d'attente, et\nle chef de gare leur a donné du café.", "prose"),
    ("Hier soir, le théâtre était plein. On\njouait une pièce nouvelle, et le public a\nrappelé trois fois les acteurs avant de\nquitter la salle.", "prose"),
    ("Der Gemeinderat hat gestern beschlossen,\ndie Straße nach dem See zu verbreitern.\nDie Arbeiten sollen im Frühjahr beginnen\nund werden, wie man hört, nicht mehr als\nzwei Monate dauern.", "prose"),
    ("In der Nacht auf Sonntag wurde bei dem\nUhrmacher am Markt eingebrochen. Die Die-\nbe nahmen vier Uhren mit, ließen aber die\nKasse stehen, weil sie gestört wurden.", "prose"),
    ("El alcalde visitó ayer la escuela y habló\ncon los niños de la última clase. Después\nprometió que el techo, por donde entra la\nlluvia, se arreglará antes del invierno.", "prose"),
    ("La cosecha de este año ha sido buena. Los\nlabradores esperan vender el trigo en la\nferia de mayo, si los caminos no están\ncortados por el río.", "prose"),
    ("He sold 40 sheep at the fair, and she,\nwho had come with 12 geese, sold them all\nbefore noon; then they drove home together\nby the upper road, as the bridge was shut.", "prose"),
    ("“We shall not give way,” said the\nchairman, and the whole room rose to\nits feet. The vote was taken at once, and\nonly two hands were raised against it.", "prose"),
    ("- John Barker, blacksmith\n- Ann Whitcombe, laundress\n- Peter Holloway, carter\n- Ruth Amory, teacher\n- Silas Penrose, miller", "list"),
    ("Smith, A., grocer, 12 High Street\nSnell, B., tailor, 4 Church Row\nSoames, C., cooper, 31 Quay Street\nSpence, D., saddler, 7 Mill Lane", "list"),
    ("1. red apples, plums\n2. green pears, quinces\n3. black cherries, grapes\n4. yellow lemons, oranges\n5. ripe figs, dates", "list"),
    ("Arrived: brig Mary, Bristol, coal\nArrived: sloop Anna, Hull, timber\nArrived: bark Venus, Cadiz, wine\nArrived: brig Hope, Riga, hemp", "list"),
    ("Goldsmiths: Miller, Vance\nBakers: Oakley, Thorpe\nPrinters: Jarrold, Finch\nBrewers: Maddox, Lane", "list"),
    ("Lot 1, oak table (kitchen)\nLot 2, brass lamp (hall)\nLot 3, feather bed (attic)\nLot 4, copper kettle (scullery)", "list"),
    ("• Anna Berger, Hebamme\n• Karl Vogt, Schreiner\n• Maria Seidl, Näherin\n• Josef Lang, Förster\n• Emil Kuhn, Lehrer", "list"),
    ("Dupont, J., boucher, 3 rue Haute\nDurand, P., notaire, 18 rue Basse\nDuval, M., épicière, 9 place Neuve\nFabre, L., menuisier, 22 quai Vert", "list"),
    ("1) camisas blancas, medias;\n2) sombreros negros, guantes;\n3) zapatos viejos, botas;\n4) mantas grises, colchas;", "list"),
    ("Robert Finlay, Edinburgh\nThomas Gray, Aberdeen\nHelen Muir, Dundee\nDavid Orr, Perth\nJanet Reid, Stirling", "list"),
    ("Schafe: Huber, Maier\nRinder: Bauer, Zangl\nPferde: Egger, Lechner\nZiegen: Moser, Pichler", "list"),
    ("schooner Elsie, Capt. Brown, for Lisbon\nschooner Nora, Capt. White, for Oporto\nbrig Ceres, Capt. Black, for Naples", "list"),
    ("Town      Births   Deaths\nAlton        112       98\nBarrow       240      201\nCalder        75       80\nDenby        131      119", "table"),
    ("Wheat .... 5s 6d .... 5s 8d\nBarley .... 3s 2d .... 3s 4d\nOats .... 2s 1d .... 2s 3d\nRye .... 3s 0d .... 3s 1d", "table"),
    ("Station | dep. | arr.\nNorthgate | 7.15 | 8.02\nElm Cross | 7.31 | 8.20\nFord | 7.48 | 8.41\nWest End | 8.05 | 9.03", "table"),
    ("Kohle\t12,50\t13,00\nHolz\t7,25\t7,40\nSalz\t3,10\t3,05\nMehl\t18,60\t18,90", "table"),
    ("Blé   21.50   22.00   21.75\nSeigle   14.25   14.50   14.00\nAvoine   9.80   9.95   10.10", "table"),
    ("High water    6 14    6 37\nLow water    12 20    12 49\nMoon rises    9 02    9 58\nSun sets    5 41    5 39", "table"),
    ("TRIGO ......... | 34 | 36½ | 35\nCEBADA ........ | 19½ | 20 | 21\nCENTENO ....... | 22 | 22½ | 23", "table"),
    ("1879 .. 4,512 .. 3,987\n1880 .. 4,730 .. 4,102\n1881 .. 4,688 .. 4,255\n1882 .. 5,019 .. 4,390", "table"),
    ("Consols 98⅜ 98½\nRailway A 104¼ 105\nRailway B 87 87¾\nGas Co. 61½ 62", "table"),
    ("Max. 61 63 58 60\nMin. 44 47 41 43\nRain 0.12 0.00 0.31 0.05", "table"),
    ("Essen  8.10  12.45  17.30\nBonn  9.02  13.41  18.26\nTrier  11.15  15.50  20.33", "table"),
    ("shirts    14    3 6    2 9 0\nboots     22    8 0    8 16 0\nhats       9    4 3    1 18 3", "table"),
    ("xqv zrtl pwkd mnbg\nhjkl trwq zzxp vbn\nqwrt plkj hgfd\nmnbv cxzl kjhg trq", "junk"),
    ("#~ |}{ ^^ *&% $$@ !~\n%% ^^&* (*) {}[]\n~~ || \\\\ // ^^ ++\n@@ ## $$ %% ^^", "junk"),
    ("the the of the the of\nof the the of of the\nthe of of the the the\nof of the the of the", "junk"),
    ("gninrom yadseuT no\negdirb wen eht\n.dworc egral a erofeb\neh ohw nem eht deknaht", "junk"),
    ("T h e m a y o r o p e n\ne d t h e b r i d g e o\nn T u e s d a y m o r n", "junk"),
    ("Ã©Ã¨ â€™ Ã¼ Â¤ Ã±\nâ€œ Ãƒ Â§ â‚¬ Ã¶ Ã\nÂ° Ã© Ã¢ â„¢ Â¶ Ã", "junk"),
    ("il. ,i li; l|i .l1 I\nl ,. il| i;l 'l. ,\n.i l, |l1 i. ;l I|\n,l i. l; .|i", "junk"),
    ("ttsb Wkrf gdnp lvck\nBrvsk ptlm dgnh ktrz\nrmvk sptl bgdn hzrk\nMtsk vlpd grnb", "junk"),
    ("lr3 t#m q*x b%n\nr¦k v§l p¬d g=n\nm+k s<p b>g z^r", "junk"),
    ("reH nned ,etsro rev rovad\neid ni tsi tdatS red\n.nebah nie nehcrik reiv", "junk"),
    ("de la de de la de la la\nla de la la de de la de\nde de la de la la de", "junk"),
    ("0 0 0 o o 0 o . . o 0\n. o 0 0 . o o 0 . 0 o\no . 0 o . . 0 0 o o .", "junk"),
]
