"""Work lists: the steps of a maintenance job as numbered rows of text. Nothing is executed."""
