from chomeflow.cli import main

raise SystemExit(main())
