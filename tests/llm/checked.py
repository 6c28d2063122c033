"""Documents of the scale 0.1 table whose kind was judged by reading them; they are only for measuring."""

KINDS = {
    "prose": "168 363 381 610 1164 1632 1994 2081 2184 3492 4527 4612 4713 5242 5430 5437 5515 5647 6095 6401 6449 6550 7024 7233 8006 8173 8206 8816 8878 9491 9700 9915",
    "list": "144 158 252 310 339 348 597 713 890 1329 1532 2000 2048 2109 2419 2593 2951 3352 3545 4222 4463 4614 4758 4800 5062 5329 5929 6451 6879 7071 7409 7639 7716 7845 8582 9091 9586 9864 9995",
    "table": "126 550 896 1455 1467 1970 2021 2262 2327 2535 2569 2754 2944 3060 3242 3267 3445 3743 4497 4503 4617 4776 4801 4843 4890 5172 5284 5477 5661 5959 5961 6369 6593 6770 6784 6918 7070 7227 8017 8020 8134 8547 8938 8962 9085 9304 9771",
    "junk": "163 367 384 689 833 1019 1428 2045 2669 2708 3373 3383 3761 4429 4897 5802 6116 6184 6363 6551 6640 6889 6893 7052 7531 7773 8117 8604 8607 9235 9427 9552",
}
BY_ID = {int(i): kind for kind, ids in KINDS.items() for i in ids.split()}
