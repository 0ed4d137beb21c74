"""Where the tables of the tests lie."""

SF = "/root/testdata/sf0.001"
