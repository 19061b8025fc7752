"""Named queries over the test tables, each with an SQL statement to check it by where SQL can say it."""
