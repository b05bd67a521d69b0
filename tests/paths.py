"""Where the test data stands."""

SMALL = "/root/testdata/sf0.001"
